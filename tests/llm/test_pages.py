"""Pages of other makes than the given ones."""

from __future__ import annotations

import pytest

from larkspur.llm import html_extract

T = "Some words of running text that stand alone here and go on for a while."
PAGES = {
    "text straight in boxes": (f"<body><div>{T}</div><div>{T}</div></body>", f"{T}\n\n{T}"),
    "a table's cell": (f"<body><div class=menu><a href=x>One</a></div><table><tr><td>{T}</td></tr></table><div id=footer>c 2020</div></body>", T),
    "comments are articles, main has the text": (f"<body><main><p>{T}</p></main><section><article><p>I liked it</p></article></section></body>", T),
    "names of paragraphs in an article": (f"<article><p>{T}</p><p class=social>{T}</p><div class=social>Share this</div></article>", f"{T}\n\n{T}"),
    "boxes around paragraphs": (f"<body><div>Home</div><div><p>{T}</p><p>{T}</p></div></body>", f"{T}\n\n{T}"),
}


@pytest.fixture(scope="module")
def weights(spark):
    return html_extract.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_text_of_other_makes(weights, name):
    page, text = PAGES[name]
    assert html_extract.extract(page, weights) == text
