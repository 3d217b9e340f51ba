"""Main text of pages whose readers' comments, forms and notes come under other names, and the table's odd rows."""

import pytest
from pyspark.sql import functions as F

from driftcloud.llm import html_density

BODY = "A long paragraph of the text itself with many words and no markup between them. " * 4
TEXT = f"<h1>Title</h1><p>{BODY}</p><p>Second. {BODY}</p>"
WANT = f"Title {BODY.strip()} Second. {BODY.strip()}"
COMMENT = "<p>I read this and I do not agree with any of it, as I have said here many times before today.</p>" * 3


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>", "<main>{}</main>", '<div class="post has-comments">{}</div>', '<form action="x">{}</form>', '<form><div class="page"><article>{}</article></div></form>'])
@pytest.mark.parametrize(
    "after",
    [
        "",
        f'<section class="user-comments">{COMMENT}</section>',
        f'<section id="reader-comments">{COMMENT}</section>',
        f'<div class="discussion">{COMMENT}</div>',
        f'<ol class="commentlist"><li>{COMMENT}</li><li>{COMMENT}</li></ol>',
        f'<div id="disqus_thread">{COMMENT}</div>',
        f'<article class="comment">{COMMENT}</article><article class="comment">{COMMENT}</article>',
        '<p class="sponsor-note">Paid for by someone who sells things.</p>',
        "<form><label>Mail</label><p>Write to us with your name.</p><input><button>Send</button></form>",
    ],
)
def test_what_follows_goes_and_the_text_stays(around, after):
    if around.startswith("<form") and after.startswith("<form"):
        pytest.skip("forms don't nest")
    assert html_density.main_text(f"<html><body>{around.format(TEXT + after if 'note' in after else TEXT)}{'' if 'note' in after else after}</body></html>") == WANT
    assert html_density.main_text(f"<html><body>{around.format(TEXT + after)}</body></html>") == WANT


def test_commentary_is_a_text():
    assert html_density.main_text(f'<body><article class="commentary">{TEXT}</article></body>') == WANT
    assert html_density.main_text(f'<body><div class="comment-enabled">{TEXT}</div></body>') == WANT


def test_rows_of_every_kind(spark):
    schema = "page_id long, url string, html string"
    page = f"<html><body><nav><ul><li>a</li></ul></nav><article>{TEXT}</article></body></html>"
    long = "<html><body><article>" + "".join(f"<p>Paragraph {k}. {BODY}</p>" for k in range(12_000)) + "</article></body></html>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "v", ""), (4, "v", "no markup at all"), (5, "v", "<<<>&#0;&bogus;"), (6, "w", long), (7, "w", "<article>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, schema).withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "lines": F.lit(0)})
    out = html_density.extract_main_text(pages.repartition(3)).collect()
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r)
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for k in (1, None) for r in by[k]] == [WANT] * 3 and by[2][0].text == by[3][0].text == "" and by[4][0].text == "no markup at all" and by[7][0].text == "deep"
    assert by[6][0].text == " ".join(f"Paragraph {k}. {BODY.strip()}" for k in range(12_000))
    assert html_density.extract_main_text(pages.limit(0)).count() == 0


def test_the_threshold_decides_without_names():
    """Where no name speaks, short lines before and after the text go by their ratio alone."""
    short = "<div><div><span>Top</span></div></div><div><div><b>x</b></div></div>" * 3
    html = f"<body>{short}<div>{TEXT}</div>{short}</body>"
    assert html_density.main_text(html) == WANT
    assert html_density.main_text(html, threshold=0.0) != WANT
