"""Token ids of whole texts against the libraries, and flat files against what was written."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracklume.llm import registry, tokens
from tracklume.llm import token_files as F

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "   ", "a  b \n\n  c\t d ", "\n \n  x", "<|endoftext|> a<|endoftext|>", "<s> </s> <unk> <0x0A>", "日本 語 é", "a▁b", "'s don't  'LL", "x\xa0y z", "　 q", "1234 ²½ 7a8 !!?? ..", "\r\n a", "\x00 \x1c\x1f\x85 a", "😀 a  😀", "é ª º", "word " * 30, "x" * 9000]


def texts():
    own = random.Random(3)
    bits = ["a", "b c", " ", "  ", "\n", "\t", "1", "!", "'s", "é", "the ", "ж", "\xa0", "ß", "́", "▁", " "]
    return ODD + ["".join(own.choice(bits) for _ in range(own.randint(1, 40))) for _ in range(2000)]


def test_ids_are_the_libraries(monkeypatch):
    plain, marked = Tokenizer.from_file(BYTE), Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 50)
    for x in texts():
        assert tokens.byte_level(BYTE, True)(x) == marked.encode(x, add_special_tokens=False).ids
        assert tokens.byte_level(BYTE, False)(x) == plain.encode(x, add_special_tokens=False).ids
        assert tokens.pieces(PIECE)(x) == model.encode(x)


def test_bytes_of_ids():
    a, b = tokens.byte_level_bytes(BYTE), tokens.piece_bytes(PIECE)
    for x in texts():
        assert b"".join(a[i] for i in tokens.byte_level(BYTE, False)(x)) == x.encode()
        if x and "▁" not in x:
            assert b"".join(b[i] for i in tokens.pieces(PIECE)(x)) == b" " + x.encode()


def wanted(rows):
    whole = Tokenizer.from_file(BYTE)
    out, start = [], 0
    for doc, value in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(value or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    found = registry.queries()["op13_token_files"](spark, SF).collect()
    assert sorted(map(tuple, found)) == wanted(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))


@pytest.mark.parametrize("vocabulary", [50_257, 1 << 20])
def test_files(spark, tmp_path, vocabulary, monkeypatch):
    monkeypatch.setattr(F, "READ_IDS", 64)
    rows = [(7, None), (3, ""), (-5, "the end"), (11, "word " * 5000), (4, "é ж"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start long, ids string")
    manifest, folder, scratch = F.dataset(docs, lambda: tokens.byte_level(BYTE, True), vocabulary, 2)
    assert [tuple(r) for r in F.token_digests(manifest, folder).orderBy("start").collect()] == wanted(rows)
    lists = F.read_token_files(manifest, folder).orderBy("start").collect()
    assert [(r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in lists] == wanted(rows)
    for r in manifest.collect():
        part = F.open_part(F.local_path(folder), r["name"], r["width"], r["docs"])
        assert len(part.ids) == r["ids"] and part.ids.itemsize == F.width(vocabulary) == r["width"] and len(part.offsets) == r["docs"] + 1
    scratch.drop()


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "same"), (1, "same"), (1, "other"), (None, None), (None, None), (2, "b")]
    manifest, folder, _ = F.dataset(spark.createDataFrame(rows, "doc_id long, text string"), lambda: tokens.byte_level(BYTE, True), 50_257, None)
    found = F.read_token_files(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, 1, 1, 1, 2] and [r.start for r in found] == np.cumsum([0, *(len(r.ids) for r in found)])[:-1].tolist()
    manifest, folder, _ = F.dataset(spark.createDataFrame([], "doc_id long, text string"), lambda: tokens.byte_level(BYTE, True), 50_257, 2)
    assert F.token_digests(manifest, folder).count() == F.read_token_files(manifest, folder).count() == 0
