"""Pages whose attributes, forms and anchors only look like boilerplate, and images that are damaged."""

import numpy as np
import pytest

from tracklume.llm import html_text as H
from tracklume.llm import media as M

TEXT = [f"This is sentence {i} of an article that goes on for some time, with commas and all." for i in range(12)]
ARTICLE = "".join(f"<p>{x}</p>" for x in TEXT)
WHOLE = "\n\n".join(TEXT)


@pytest.mark.parametrize("attributes", ["title='a hidden gem'", "data-hidden='false'", "data-class='comments'", "data-id=\"sidebar\"", "aria-label=\"class='ad'\"", "data-x=hidden"])
def test_words_in_values(attributes):
    page = f"<body><article>{ARTICLE}<div {attributes}><p>Kept all the same.</p></div></article></body>"
    assert H.extract(page) == f"{WHOLE}\n\nKept all the same."


def test_links_to_hidden_places():
    assert H.extract(f"<article>{ARTICLE}<p>See <a href='/hidden/place'>that place</a>.</p></article>").endswith("See that place.")


@pytest.mark.parametrize("attributes", ["hidden", "class='ad'", "CLASS=ad", "class=\"wide ad\"", "style='display: none'", "aria-hidden=true"])
def test_real_attributes(attributes):
    assert H.extract(f"<body><article>{ARTICLE}<div {attributes}><p>Buy this now.</p></div></article></body>") == WHOLE


def test_page_in_a_form():
    assert H.extract(f"<body><form id=aspnetForm><article>{ARTICLE}</article></form></body>") == WHOLE
    assert H.extract(f"<body><form action='/'><div>{ARTICLE}</div></form></body>") == WHOLE
    assert H.extract(f"<body><div>{ARTICLE}</div><form><p>Your name, please</p><input name=a></form></body>") == WHOLE
    assert H.extract(f"<body><article>{ARTICLE}<form><p>Your name, please</p></form></article></body>") == WHOLE


@pytest.mark.parametrize("box", ["<section id='social'>", "<div id='login'>", "<div id=copyright>"])
def test_anchors_in_an_article(box):
    tag = box[1:].split()[0].rstrip(">")
    page = f"<body><article>{ARTICLE}{box}<h2>On the subject</h2><p>What this part has to say.</p></{tag}></article></body>"
    assert H.extract(page) == f"{WHOLE}\n\nOn the subject\n\nWhat this part has to say."
    links = f"<body><article>{ARTICLE}{box}<a href=a>Share this</a> <a href=b>Send it to friends</a></{tag}></article></body>"
    assert H.extract(links) == WHOLE


def test_text_as_it_stands():
    assert H.extract(f"<article>{ARTICLE}<xmp><b>5 &amp; 6</b></xmp></article>") == f"{WHOLE}\n\n<b>5 &amp; 6</b>"


def test_damaged_images(spark):
    good = M.encode_pgm(np.arange(12, dtype=np.uint8).reshape(3, 4))
    images = [good, b"P2 2 1 255 300 1", b"P2 2 1 255 -1 1", b"P2 0 0 255 ", b"P5 0 0 255\n", b"P5 2 1 100\n\xc8\x01", good[:-3], b"P5", b"BM", b"", None, b"P2 1 1 70000 5", b"P2 2 1 255 x y", M.encode_bmp(np.zeros((2, 2, 3), np.uint8)), b"P5 2 1 1000\n\x07\xd0\x00\x01", b"P5 2 1 1000\n\x03\xe8\x00\x01"]
    rows = M.image_tiles(spark.createDataFrame(list(enumerate(images)), "k int, image binary"), "image", 2, 2).orderBy("k").collect()
    assert [r.k for r in rows if r.tile is not None] == [0, 13, 15] and all((r.tile is None) == (r.feature is None) for r in rows)
    assert M.from_npy(rows[0].tile).shape == (2, 2) and M.from_npy(rows[15].tile).dtype == np.uint16


def test_texts_as_images(spark):
    """A long text, an empty table, repeated rows, nulls and other columns."""
    rows = [(1, "x" * 300_000, 7), (1, "x" * 300_000, 7), (None, None, 7), (2, "", 7), (3, "é" * 33, 7)]
    found = M.text_tiles(spark.createDataFrame(rows, "doc_id long, text string, tile int")).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(M.from_npy(r.tile).tobytes())
    assert len(found) == 5 and by[1] == [b"x" * 300_000 + bytes(32)] * 2 and by[None] == by[2] == [bytes(64)] and by[3] == ["é".encode() * 33 + bytes(62)]
    assert M.text_tiles(spark.createDataFrame([], "doc_id long, text string")).count() == 0
