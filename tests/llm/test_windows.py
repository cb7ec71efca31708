"""On pages with an article the windows decide, not the tags alone."""

import pytest

pytest.importorskip("public_tokenizers")

from textmill.llm import html  # noqa: E402

PARAGRAPH = "A paragraph of the article that goes on for quite a while, as they do."
LONG = "More of the story stands outside of the element, as sloppy templates have it, and it is as long as any other paragraph of it is."
STRAY = "".join(f"<div>{w}</div>" for w in ("Imprint", "Contact", "Terms", "Jobs"))
ARTICLE = f"<article><h1>Head</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>So.</p></article>"


def by_tags(page):
    """The lines that tags and classes leave, without any window."""
    return "\n".join(text for text, beside, main in html.page_lines(page) if main and not beside)


CASES = [
    # Long text outside of the article, side by side with it: kept by its own surge.
    (f"{ARTICLE}<div>{LONG}</div>", lambda t: t.endswith(LONG) and t.startswith("Head")),
    # Behind a dive it is a stretch of its own, which has no line of an article.
    (f"{ARTICLE}{STRAY}<div>{LONG}</div>", lambda t: LONG not in t and t.endswith("So.")),
    # A short line outside has no surge.
    (f"<div>Home</div>{ARTICLE}<div>Copyright of this page, by all its owners.</div>", lambda t: t.startswith("Head") and t.endswith("So.")),
    # An article element too thin for a surge, behind a dive, isn't the article.
    (f"{ARTICLE}{STRAY}<article>Teaser.</article>", lambda t: t.endswith("So.")),
]


@pytest.mark.parametrize("page,good", CASES)
def test_windows_find_the_span(page, good):
    assert good(html.main_text(page))


def test_ablation():
    """Without windows, or without the prior, other lines are kept."""
    changed = [html.main_text(page) != by_tags(page) for page, _ in CASES]
    assert changed == [True, False, False, True]
    thin = "<article><p>One.</p><p>Two.</p><p>Three.</p></article><div>Home</div>"
    assert html.main_text(thin) == "One.\nTwo.\nThree."  # three lines of an article have a surge by the prior
    marked = html.SURGE
    try:
        html.SURGE = 10_000
        assert html.main_text(CASES[0][0]) != "" and LONG not in html.main_text(CASES[0][0])  # no text outside reaches such a mark
    finally:
        html.SURGE = marked


def test_no_line_has_a_surge_by_its_place():
    assert html.PRIOR < html.SURGE <= html.WINDOW * (html.PRIOR + 1)
    sizes = html.weights([("x", False, True), ("y" * 30, False, False), ("z", True, True)])
    assert sizes == [html.PRIOR + 1, 0, 0] or sizes[2] == 0
