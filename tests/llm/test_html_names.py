"""Names and links that must not cost a page its text."""

import pytest

from factloom.llm.html_text import main_text

A, B = "One sentence, of some length here, and more of it.", "Another, longer sentence; it goes on, and on, to its end."
TEXT = f"<p>{A}</p><p>{B}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<html><body class="single has-sidebar">{TEXT}</body></html>',
        f'<html class="nav"><body class="comments-open search">{TEXT}</body></html>',
        f'<body><article class="sponsored social">{TEXT}</article></body>',
        f'<body><main id="search">{TEXT}</main></body>',
        f'<body><div id="search-results">{TEXT}</div></body>',
        f'<body><div class="widget">{TEXT}</div></body>',
        f'<body><article><p class="social-science">{A}</p><p>{B}</p></article></body>',
        f'<body><div style="overflow:hidden">{TEXT}</div></body>',
        f'<body><div aria-hidden="false" data-x="class=menu">{TEXT}</div></body>',
        f'<body><article><p>{A}</p><p><a href="/hidden-gems">{B[:9]}</a>{B[9:]}</p></article></body>',
        f'<body><article><p>{A}</p><p><a href="/x">{B}</a></p></article></body>',
    ],
)
def test_text_stays(page):
    assert main_text(page) == f"{A}\n{B}"


@pytest.mark.parametrize("attributes", ['class="comments-area"', 'id="cookie-banner"', "class='site sidebar-left'", "hidden", 'hidden=""', 'role="navigation"', 'class="related"'])
def test_chrome_goes(attributes):
    assert main_text(f"<body><article>{TEXT}<div {attributes}><p>Short, other text.</p></div></article></body>") == f"{A}\n{B}"


def test_long_comments_beside_an_article_go():
    assert main_text(f'<body><article>{TEXT}</article><div class="comments">{TEXT * 3}</div></body>') == f"{A}\n{B}"


LINKS = "".join(f'<li><a href="/{k}">Link number {k}</a></li>' for k in range(3))
NAMES = "Link number 0\nLink number 1\nLink number 2"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article>{TEXT}<ul><li>One</li><li>Two</li><li>Three</li></ul></article>", f"{A}\n{B}\nOne\nTwo\nThree"),
        (f"<article>{TEXT}<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table></article>", f"{A}\n{B}\na\nb\nc\nd"),
        (f"<article>{TEXT}<div>One</div><div>Two</div><div>Three</div></article>", f"{A}\n{B}\nOne\nTwo\nThree"),
        (f"<article><blockquote>Said.</blockquote><dl><dt>T</dt><dd>D</dd></dl><h2>H</h2>{TEXT}</article>", f"Said.\nT\nD\nH\n{A}\n{B}"),
        (f"<article><div>A. Name</div><div>1 May</div>{TEXT}</article>", f"A. Name\n1 May\n{A}\n{B}"),
        (f"<article>{TEXT}<h2>Sources</h2><ul>{LINKS}</ul></article>", f"{A}\n{B}\nSources\n{NAMES}"),
        (f"<main><article>{TEXT}</article><article>{TEXT}</article></main>", f"{A}\n{B}\n{A}\n{B}"),
        (f'<form action="/"><nav>Menu</nav><article>{TEXT}</article></form>', f"{A}\n{B}"),
        (f'<form action="/"><div><p>{A}</p><p>{B}</p></div></form>', f"{A}\n{B}"),
        (f"<article>{TEXT}<form>Your name <input> and mail</form></article>", f"{A}\n{B}"),
        (f"<div><div>{TEXT}<ul><li>One</li><li>Two</li></ul></div><div><ul>{LINKS}</ul></div></div>", f"{A}\n{B}\nOne\nTwo"),
        (f"<div>{TEXT}</div><ul>{LINKS}</ul>", f"{A}\n{B}"),
    ],
)
def test_nothing_of_the_article_is_lost(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want
