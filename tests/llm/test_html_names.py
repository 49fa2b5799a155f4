import time

import data
from lodestone.llm import html_text

BODY = "".join(f"<p>Paragraph {i} says a good deal about the matter at hand, as paragraphs do.</p>" for i in range(5))
TEXT = "\n".join(f"Paragraph {i} says a good deal about the matter at hand, as paragraphs do." for i in range(5))


def test_names_that_only_look_unwanted():
    assert html_text.extract(f'<article><div class="post-header"><h1>Title</h1></div>{BODY}</article>') == "Title\n" + TEXT
    assert html_text.extract(f'<article>{BODY}<section class="legal-analysis"><p>An analysis.</p></section></article>') == TEXT + "\nAn analysis."
    assert html_text.extract(f'<body><div class="two side-by-side">{BODY}</div></body>') == TEXT
    # a name doesn't take most of the page away, but what stands within and is unwanted goes
    assert html_text.extract(f'<div class="related">{BODY}<div class="ad">Buy this now</div></div><p>End</p>') == TEXT + "\nEnd"
    for name in ("ad", "cookie-banner", "site-footer", "main-nav", "comment-list", "sidebar_left", "site-header", "legal"):
        assert html_text.extract(f'<article>{BODY}</article><div class="x {name}">Unwanted words</div>') == TEXT
        assert html_text.extract(f'<div>{BODY}<div id="{name}"><p>Unwanted words</p></div></div>') == TEXT
    assert html_text.extract(f'<div>{BODY}<p>One <span class="ad">unwanted</span> two</p></div>') == TEXT + "\nOne\ntwo"


def test_lists_and_tables_without_end_tags():
    assert html_text.extract(f"<article>{BODY}<ul><li>a<li><p>b<li>c</ul><table><tr><td>d<td>e<tr><td>f</table></article>") == TEXT + "\na\nb\nc\nd\ne\nf"


def test_broken_markup_takes_linear_time():
    n = 40_000
    pages = ["<i>" * n + "</b>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<i>" * n + "<hr>" * n, "<section>" * n + "<td></td>" * n, "<li><div>" + "<section>" * n + "<li></li>" * n, "<div>" * n + "</div>" * n, "<p>" * n, "</p>" * n]
    for page in pages:
        began = time.time()
        assert html_text.extract(page + BODY).endswith(TEXT)
        assert time.time() - began < 5, page[:30]


def test_rows(spark):
    rows = [(None, "u", "<p>x</p>", 1, "clash"), (1, None, None, 1, "clash"), (2, "u", "", 1, "clash"), (2, "u", f"<article>{BODY}</article>", 1, "clash"), (2, "u", f"<article>{BODY}</article>", 1, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).collect()), key=repr)
    assert got == sorted([(None, "x", 1), (1, "", 0), (2, "", 0), (2, TEXT, len(TEXT)), (2, TEXT, len(TEXT))], key=repr)
    assert html_text.main_text(df.limit(0)).count() == 0
