"""Generated pages, with and without marks, of which it is known what is the article."""

import random

import pytest

from factloom.llm import html_text

WORDS = "stone river under morning wide carried after lantern quiet seven harvest north glass between".split()


def sentences(rng, n):
    return " ".join(" ".join(rng.choices(WORDS, k=rng.randrange(8, 16))).capitalize() + rng.choice([".", "!", ", at last.", "?"]) for _ in range(n))


def article(rng, tag):
    """(html, blocks) of an article: paragraphs among short blocks of every kind."""
    kinds = ["p", "p", "p", "h2", "ul", "table", "blockquote", "div"]
    html, blocks = [], []
    for kind in ["p", "p", *rng.choices(kinds, k=rng.randrange(3, 9)), "p"]:
        items = [sentences(rng, rng.randrange(2, 4))] if kind == "p" else [" ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(1 if kind in ("h2", "div", "blockquote") else rng.randrange(1, 4))]
        inner = {"ul": "".join(f"<li>{x}</li>" for x in items), "table": "<tr>" + "".join(f"<td>{x}</td>" for x in items) + "</tr>"}.get(kind, items[0])
        html.append(f"<{kind}>{inner}</{kind}>")
        blocks += items
    return f"<{tag}>{''.join(html)}</{tag}>", blocks


def page(rng, marked):
    """A page with menus, a side bar and a footer around one to three articles; without marks only one, and nothing but paths says what is what."""
    plain = not marked and rng.random() < 0.7  # menus whose items aren't links
    links = lambda n: "".join(f"<li>{rng.choice(WORDS)}</li>" if plain else f'<li><a href="/{k}">{rng.choice(WORDS)}</a></li>' for k in range(n))
    parts = [article(rng, "article" if marked else "div") for _ in range(rng.randrange(1, 4) if marked else 1)]
    body = "".join(h for h, _ in parts)
    nav, side, foot = ("nav", "aside", "footer") if marked else ("div", "div", "div")
    body = f"<{nav}><ul>{links(6 if marked else 60)}</ul></{nav}><div>{body}</div><{side}><ul>{links(4)}</ul></{side}><{foot}><span>{rng.choice(WORDS)}</span></{foot}>"
    if marked and rng.random() < 0.3:
        body = f"<form>{body}</form>"
    return f"<html><body>{body}</body></html>", "\n".join(b for _, blocks in parts for b in blocks)


@pytest.mark.parametrize("marked", [True, False])
def test_the_article_is_found_whole(marked):
    rng = random.Random(marked)
    for _ in range(150):
        html, want = page(rng, marked)
        assert html_text.main_text(html) == want, html


def test_scores_decide_on_pages_without_marks(monkeypatch):
    rng = random.Random(9)
    pages = [page(rng, False) for _ in range(60)]
    monkeypatch.setattr(html_text, "path_scores", lambda found: [0.0 if b.chrome else 1.0 for b in found])
    assert sum(html_text.main_text(html) != want for html, want in pages) > 30
