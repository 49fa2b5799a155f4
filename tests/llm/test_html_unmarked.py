import pytest

from lodestone.llm import html_text

P = lambda *lines: "<body><div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div></body>"
LINK = "<a href=x>more about this</a>"
LONG = "body " * 60


@pytest.mark.parametrize(
    "lines, want",
    [
        (["a short title", "one line", "x"], None),  # no surge at all
        (["短い記事です。", "二行目。"], None),
        ([f"{i} " + "o" * 98 for i in range(10)] + ["w" * 6000], None),  # very uneven
        (["Title", LONG.strip()], None),
        ([LONG.strip(), LINK, LINK, LINK, LONG.upper().strip()], [LONG.strip(), LONG.upper().strip()]),  # interrupted
        ([LINK, LINK, LINK, LINK, LONG.strip()], [LONG.strip()]),
    ],
)
def test_unmarked_pages_keep_their_article(lines, want):
    assert html_text.extract(P(*lines)) == "\n".join(want or lines)


def test_teasers_in_article_tags_dont_hide_the_body():
    page = "<article><p>teaser one</p></article><article><p>teaser two</p></article><div>" + "".join(f"<p>{LONG}{i}</p>" for i in range(3)) + "</div>"
    got = html_text.extract(page)
    assert all(f"{LONG}{i}" in got for i in range(3))
