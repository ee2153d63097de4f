"""Main text against pages whose own text is known from how they were made."""

from __future__ import annotations

import random

import pytest

from whygraph.llm import html_extract
from whygraph.llm.common import KEY, with_key

WORDS = "amber basin cedar delta ember fjord grove haven inlet juniper knoll lagoon meadow north orchard prairie quarry ridge summit tundra".split()


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."


def extracted(spark, pages):
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r[KEY]: r.text for r in html_extract.main_text(with_key(rows, "page_id")).collect()}


#: Layouts of {0} (a short text of the page) and {1} (a long one), with the text that is the page's own.
LAYOUTS = {
    "two paragraphs": ("<body><p>{0}</p><p>{1}</p></body>", "{0} {1}"),
    "heading above a block": ("<body><h1>{0}</h1><div>{1}</div></body>", "{0} {1}"),
    "short block beside a long one": ("<body><div>{0}</div><div>{1}</div></body>", "{0} {1}"),
    "box with a class around a paragraph": ("<body><div class=lead><p>{0}</p></div><div>{1}</div></body>", "{0} {1}"),
    "list beside a block": ("<body><ul><li>{0}</li><li>{0}</li></ul><div>{1}</div></body>", "{0} {0} {1}"),
    "quotation": ("<body><blockquote>{0}</blockquote><section><p>{1}</p></section></body>", "{0} {1}"),
    "second article": ("<body><article><p>{1}</p></article><article><p>{0}</p></article></body>", "{1} {0}"),
    "articles in a list": ("<body><div><div><article>{0}</article></div><div><article>{1}</article></div></div></body>", "{0} {1}"),
    "paragraph of links": ("<body><p>{1}</p><p><a href=x>{0}</a></p></body>", "{1} {0}"),
}


@pytest.mark.parametrize("n_pages", [4, 8])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_own_text_stays_whatever_its_structure(spark, layout, n_pages):
    draw = random.Random(layout)
    source, own = LAYOUTS[layout]
    texts = [(sentence(draw, 6), " ".join(sentence(draw, 12) for _ in range(4))) for _ in range(n_pages)]
    got = extracted(spark, [(i, f"https://a.example/{i}", f"<html>{source.format(*t)}</html>") for i, t in enumerate(texts)])
    assert got == {i: own.format(*t) for i, t in enumerate(texts)}


def test_unmarked_menus_and_boxes_go_where_they_recur(spark):
    """Link lists with other entries, and equal boxes, go on large hosts without any tag or class that tells them."""
    draw = random.Random(5)
    pages, want = [], {}
    for i in range(20):
        menu = "".join(f"<li><a href={k}>{draw.choice(WORDS)} {i + k}</a></li>" for k in range(draw.randrange(3, 7)))
        own = " ".join(sentence(draw, 15) for _ in range(5))
        pages.append((i, "https://b.example/", f"<body><div><ul>{menu}</ul></div><div><div>All rights kept by us</div><p>{own}</p></div></body>"))
        want[i] = own
    assert extracted(spark, pages) == want
