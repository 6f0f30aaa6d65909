"""Alignments against all pairs of tokens, by hand and by the tokenizers."""

import hashlib
import random
import sys
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark import cloudpickle
from tokenizers import Tokenizer

from tracklume.llm import alignment as A
from tracklume.llm import registry, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def plain(rows, sides):
    """The contract's row of each document, from every pair of its tokens."""
    found = []
    for doc, text in rows:
        ids = [encode(text) if text else [] for encode, _ in sides]
        if not text or any(b"".join(table[i] for i in x) != f" {text}".encode() for x, (_, table) in zip(ids, sides, strict=True)):
            ids = [[], []]
        spans = []
        for x, (_, table) in zip(ids, sides, strict=True):
            ends = [0]
            for i in x:
                ends.append(ends[-1] + len(table[i]))
            spans.append(list(zip(x, ends, ends[1:], strict=False)))
        met = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in both:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if low <= s < cut) for side in spans))
            low = cut
        found.append((doc, ids, met, groups))
    counts = Counter(p for _, _, met, _ in found for p in set(met))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (doc, len(ids[0]), len(ids[1]), len(groups), len(met), sum(counts[p] == most[p[0]] for p in met), sum(counts[p] for p in met), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, ids, met, groups in found
    ]


def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tables = tokens.byte_level_bytes(public_tokenizers.path("byte_bpe_50k.json")), tokens.piece_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return (lambda x: a.encode(f" {x}", add_special_tokens=False).ids, tables[0]), (b.encode, tables[1])


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, *((x or 0) if not isinstance(x, str) else x for x in r)))


def test_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = [(i, x) for i, x in zip(docs.doc_id.tolist(), docs.text, strict=True)]
    short = [(i, x) for i, x in rows if len(x) < 6000]
    frame = spark.createDataFrame(short, DOCS)
    from tracklume.llm.alignment_query import encoders

    assert order(map(tuple, A.Alignment(frame, encoders).summary().collect())) == order(plain(short, libraries()))
    whole = registry.queries()["op11_alignment"](spark, SF).collect()
    assert sorted(r.doc_id for r in whole) == sorted(docs.doc_id) and all(r.n_links >= max(r.n_a, r.n_b) for r in whole)


def made(own, sizes):
    """A tokenizer of texts of x: pieces of random sizes, an id for each size."""
    table = [b" ", *(b"x" * n for n in sizes)]

    def encode(text):
        out, left = [0], len(text)
        while left:
            n = own(text, left) % len(sizes)
            n = n if sizes[n] <= left else 0
            out.append(n + 1)
            left -= sizes[n]
        return out

    return encode, table


def sides():
    draw = lambda salt: lambda text, left: random.Random(f"{salt}{len(text)}.{left}").randrange(1 << 20)
    return made(draw("a"), (1, 2, 3, 7)), made(draw("b"), (1, 4, 5))


def test_all_pairs(spark):
    own = random.Random(7)
    rows = [(i, "x" * own.randint(0, 60)) for i in range(60)] + [(61, None), (62, ""), (63, "y"), (None, "xxx"), (None, "xxx"), (5, "xxxx"), (64, "x" * 3000)]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], f"{DOCS}, row long, a_id string")
    assert order(map(tuple, A.Alignment(docs, sides).summary().collect())) == order(plain(rows, sides()))


def test_links_and_empty_tables(spark):
    found = A.Alignment(spark.createDataFrame([(1, "xxxxx")], DOCS), lambda: ((lambda x: [0, 1, 2], [b" xx", b"x", b"xx"]), (lambda x: [0, 1], [b" ", b"xxxxx"])))
    assert [(r.begin, r.a_id, r.b_id, r.group) for r in found.links().orderBy("begin").collect()] == [(0, 0, 0, 1), (1, 0, 1, 1), (3, 1, 1, 1), (4, 2, 1, 1)]
    assert [r.groups for r in found.groups().collect()] == ["0,1,2|0,1"]
    assert A.Alignment(spark.createDataFrame([], DOCS), sides).summary().count() == 0
