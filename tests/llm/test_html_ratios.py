"""Tag-path ratios decide where no element or name says what the article is, and pages of any size take time in proportion."""

import time

from factloom.llm import html_text

A = "One sentence, of some length here, and more of it; it goes on, and on, until it comes to its end."
PLAIN = f"<html><body><div><span>Start</span></div><div><em>Shop</em></div><div><p>{A}</p><p>Short one.</p><p>{A}</p></div><table><tr><td>Imprint</td><td>Contact</td></tr></table></body></html>"


def test_ratios_select_the_nodes(monkeypatch):
    want = f"{A}\nShort one.\n{A}"
    assert html_text.main_text(PLAIN) == want
    monkeypatch.setattr(html_text, "path_scores", lambda found: [1.0] * len(found))
    assert html_text.main_text(PLAIN) != want


def test_deep_and_broken_pages_take_time_in_proportion():
    for page in ("<div>x" * 20_000, "<a " * 20_000, '<a href="x>' * 20_000, "<div>" * 10_000 + "</section>" * 10_000, '<div class="ad">x' * 10_000, "<blockquote>" * 4_000 + "<li>x</li>" * 4_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 20
