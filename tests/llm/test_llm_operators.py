"""Operators on hand-made tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklume.llm import decontamination as D
from tracklume.llm import html_text as H
from tracklume.llm import jaccard_join as J
from tracklume.llm import media as M
from tracklume.llm import packing as K
from tracklume.llm import text as T
from tracklume.llm import toxicity as X
from tracklume.llm import url_filter as U
from tracklume.llm import warc as W
from tracklume.llm.sharding import byte_shards
from tracklume.llm.substring_dedup import remove_repeats

DOCS = "doc_id long, text string"
rng = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def passage(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward():
    """Texts with shared passages, copies, ties and holes."""
    shared = [passage(30), passage(14)]
    rows = [(i, " ".join([passage(rng.randint(0, 40)), rng.choice(shared), passage(rng.randint(0, 20))])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "a b"), (104, "a b"), (None, rows[3][1]), (None, None), (50, rows[5][1]), (50, rows[5][1]), (51, passage(20_000)), (52, "é x " * 20)]
    return rows


#: Two words of 1,024 bytes that sums of powers modulo 2^64 don't tell apart.
THUE = bytes(97 + bin(i).count("1") % 2 for i in range(1024)).decode()
MORSE = THUE.translate({97: 98, 98: 97})


def crafted():
    """Texts that differ in such a word only, hot copies, and near copies from few edits to many."""
    own = random.Random(8)
    some = lambda n: [own.choice(WORDS) for _ in range(n)]
    rows, base = [], some(80)
    for i in range(6):
        around = some(12)
        rows += [(300 + i, " ".join([*around[:6], THUE, *around[6:]])), (320 + i, " ".join([*around[:6], MORSE, *around[6:]]))]
    rows += [(400 + i, " ".join(base)) for i in range(60)]
    for i in range(60):
        near = list(base)
        for _ in range(1 + i // 8):
            near[own.randrange(len(near))] = f"own{own.random()}"
        rows.append((500 + i, " ".join(near)))
    return rows


def split(text):
    return (text or "").encode().split()


def test_words():
    texts = ["a  b", None, "", "\x0bx\x1fy z\n", "  q"]
    w = T.words(pa.array(texts))
    assert np.diff(w.first).tolist() == [len(split(t)) for t in texts]
    assert [bytes(w.data[s:e]) for s, e in zip(w.starts, w.ends)] == [x for t in texts for x in split(t)]
    assert T.words(pa.array(["Ab"]), lower=True).hashes[0] == T.words(pa.array(["aB"]), lower=True).hashes[0]


@pytest.mark.parametrize("table", [awkward, crafted])
def test_substring_dedup(spark, table):
    rows = table()
    first = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    wanted = []
    for doc, text in rows:
        w, gone = split(text), set()
        for i in range(len(w) - 12):
            if doc is not None and first[tuple(w[i : i + 13])] < doc:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        wanted.append((doc, len(w), len(gone), kept))
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], DOCS + ", n_words int")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df).collect()]
    order = lambda x: sorted(x, key=str)
    assert order(got) == order(wanted) and any(x[2] for x in wanted)
    assert remove_repeats(df.limit(0)).count() == 0


def shingle_set(text, n=4):
    w = [x.decode() for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


@pytest.mark.parametrize(("n", "percent", "bits"), [(4, 85, 63), (5, 80, 63), (4, 85, 7)])
def test_jaccard(spark, n, percent, bits):
    """By brute force, long texts and rows without an id too; with few bits, digests share numbers and are told apart."""
    rows = awkward() + crafted()
    for i in range(60):  # a chain of near copies around the threshold
        w = split(rows[0][1] + " " + passage(60) if i % 20 == 0 else rows[-1][1])
        w[rng.randrange(len(w))] = b"edit%d" % i
        rows.append((200 + i, b" ".join(w).decode()))
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    wanted = [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]
    found = J.jaccard_components(spark.createDataFrame(rows, DOCS), n, percent, bits)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str) and len({x[2] for x in wanted}) < len(rows) - 60
    assert J.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_words():
    w = T.words(pa.array([f"{THUE} {MORSE} {THUE} a", "a b"]))
    assert len(set(w.hashes.tolist())) == 4
    for bits in (0, 63, 64):  # whatever the hashes are
        ids = T.exact_ids(w._replace(hashes=np.zeros_like(w.hashes) if bits == 64 else w.hashes >> np.uint64(bits))).tolist()
        assert ids[0] == ids[2] and ids[3] == ids[4] and len(set(ids)) == 4


def test_bitmap_bound_is_safe():
    for _ in range(300):
        n = rng.randint(1, 300)
        base = [rng.getrandbits(63) for _ in range(n)]
        other = [x if rng.random() < 0.93 else rng.getrandbits(63) for x in base] + [rng.getrandbits(63) for _ in range(rng.randint(0, n // 5))]
        a, b = (np.array(sorted(set(x)), np.uint64) for x in (base, other))
        sets = J.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        x, y = J.bitmaps(sets)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert J.may_link(x, y, len(a), len(b), 85)


def test_sum_of_squares():
    lengths = np.array([rng.randint(1, 100) for _ in range(2000)])
    bins, offsets = K.sum_of_squares(lengths, 100)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 100 and len(fill) <= 1.03 * lengths.sum() / 100 + 2
    order = np.lexsort((offsets, bins))
    for b in range(5):
        rows = order[bins[order] == b]
        assert offsets[rows].tolist() == [0, *np.cumsum(lengths[rows])[:-1].tolist()]
    assert K.sum_of_squares(np.array([100, 100]), 100)[0].tolist() == [0, 1]
    assert K.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and K.cut(4096, 2048) == [(0, 2048), (2048, 2048)] and K.cut(3, 2048) == [(0, 3)]


def test_tokens_agree():
    import public_tokenizers as P

    fast, slow = K._encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")), K._encoder(P.path("byte_bpe_50k.json"), None)
    for text in ["", "a", "Hello  world\n\n x", "l'été ß 12", "<|endoftext|> a", "日本 \U0001f600", "  x", "it's DON'T 3.14"]:
        assert list(fast(text)) == list(slow(text)), text


def test_sharding_ties(spark):
    rows = spark.createDataFrame([(None, "x")] * 3 + [(1, "y" * 50)] * 5 + [(2, None), (3, "")], DOCS).withColumn("slot", F.lit("taken"))
    found = byte_shards(rows, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 16, 4).toPandas()
    assert len(found) == 10 and found["size"].sum() == 3 * 17 + 5 * 66 + 32
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    assert byte_shards(rows.limit(0), "doc_id", F.lit(1), 4).count() == 0


def test_url_rules(spark):
    rows = [(1, "http://WWW.Example.com/en/1?x"), (2, "https://a.example.com/en/1#q"), (3, "http://x.net/es/"), (4, "http://x.net/es"), (5, None), (6, "no scheme"), (7, "http://b.org"), (8, "http://notexample.com/en/1"), (9, "http://net/fr/?")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id int, url string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_verdicts(df, U.RULES).collect()}
    assert found[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert found[2] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert found[3][2:] == ("net/es/", "block") and found[4][2:] == (None, "allow")
    assert found[5] == ("", "", None, "allow") and found[6] == found[5] and found[7] == ("b.org", "", None, "allow")
    assert found[8][2:] == ("com/", "allow") and found[9][2:] == ("net/fr/", "block")


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda x: len(x))
    U.build_index([("block", "ab", "/"), ("allow", "cd", "/"), ("block", "efg", "/")], str(tmp_path / "i"))
    assert U.Index(str(tmp_path / "i")).find([b"cd/", b"ab/", b"zz/", b"efg/"]).tolist()[2] == -1
    index = U.Index(str(tmp_path / "i"))
    assert [bool(index.blocks[k]) for k in index.find([b"cd/", b"ab/", b"efg/"])] == [False, True, True]


def test_html():
    page = "<html><body><nav><a href=x>Home</a></nav><div class=ad>Buy</div><article><h1>T &amp; U</h1><p>One<br>two <b>three</p><p>" + "Long enough text here. " * 9 + "</article><section id='comments'><p>me too</p></section><footer>f</footer>"
    assert H.extract(page) == "T & U\n\nOne two three\n\n" + ("Long enough text here. " * 9).strip()
    assert H.extract(None) == "" and H.extract("<script>x</script>") == "" and H.extract("plain  text") == "plain text"
    assert H.extract("<p>a" * 3000).count("a") == 3000
    assert H.extract("<div>" * 5000 + "deep") == "deep"


def test_media():
    grey = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (M.decode(M.encode_pgm(grey)) == grey).all() and (M.from_npy(M.to_npy(grey)) == grey).all()
    assert M.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert M.decode(b"P2 2 1 9 3 7").tolist() == [[3, 7]] and M.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P4 3 1\n\xa0").tolist() == [[0, 1, 0]] and M.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    head = b"BM" + (70).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24)
    assert M.decode(head + bytes([1, 2, 3, 4, 5, 6, 0, 0])).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert M.area_resize(grey, 3, 4) == pytest.approx(grey.reshape(3, 2, 4, 2).mean((1, 3)))
    assert M.area_resize(grey, 5, 7).mean() == pytest.approx(grey.mean())
    assert M.difference_hash(np.tile(np.arange(64, dtype=np.uint8), (8, 1))) == "f" * 16


def test_media_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x" * 200, 5)], DOCS + ", tile int")
    found = {r.doc_id: r for r in M.text_tiles(df).collect()}
    assert found[1].tile == found[2].tile and found[1].n_bytes == 0 and M.from_npy(found[3].tile).shape == (4, 64)
    images = spark.createDataFrame([(1, b"P2 2 2 9 1 2 3 4"), (2, b"junk"), (3, None)], "id int, image binary")
    assert [r.tile is None for r in M.image_tiles(images, "image", 1, 1).orderBy("id").collect()] == [False, True, True]


def test_clauses():
    grammar = X.Grammar({"idiot": 2.0})
    score = lambda t: X.text_score(t, grammar.automaton())
    assert score("nothing here") == 0 and score("") == 0
    assert score("you are an idiot.") > score("an idiot.") > score("not an idiot.") > 0
    assert score("she said an idiot came") < score("she is an idiot")
    assert score("I will kill you") > 0 and score("kill the lights") == 0 and score("skill for you") == 0
    assert score("idiotic! idiot!") == 2 * score("idiot!")


def test_composed_transducers():
    """The composition against the rules in words, over all short clauses of marks."""
    import itertools

    word = {"insult": "x", "threat": "k", "target": "you", "negation": "not", "report": "said", "other": "o"}
    for marks in itertools.product(X.MARKS, repeat=5):
        wanted, said, left = 0.0, False, 0
        for i, mark in enumerate(marks):
            weight = {"insult": 2.0 * (X.TARGETED if "target" in marks else X.UNTARGETED), "threat": float("target" in marks[i:])}.get(mark, 0.0)
            wanted += weight * (X.NEGATED if left else 1) * (X.REPORTED if said else 1)
            said, left = said or mark == "report", X.NEGATION_REACH if mark == "negation" else max(0, left - 1)
        insults = {i: 2.0 for i, m in enumerate(marks) if m == "insult"}
        threats = {i for i, m in enumerate(marks) if m == "threat"}
        assert X.clause_score([word[m] for m in marks], insults, threats) == pytest.approx(wanted), marks


def test_toxicity_rows(spark):
    """Repeated rows, copies of unequal labels, long texts, an empty table and a column named like the result."""
    rows = [(i, ("grumph " if i % 4 == 0 else "") + passage(12), 1.0) for i in range(200)]
    rows += [(300, rows[0][1], 1.0), (301, rows[0][1], 1.0), *rows[:3], (400, passage(30_000) + " grumph you", 1.0)]
    texts = spark.createDataFrame(rows, DOCS + ", score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(300, 0), (301, 1), (0, 0)], "doc_id long, toxic int")
    learned = [X.learn(texts.orderBy(F.rand(seed)), labels, "doc_id", "toxic", F.lit(True)) for seed in (1, 2)]
    assert learned[0] == learned[1] and learned[0].stems
    found = X.scores(texts, learned[0]).collect()
    assert len(found) == len(rows) and all((r.score >= 0.5) == (r.doc_id % 4 == 0 or r.doc_id == 301) for r in found)
    assert X.scores(texts.limit(0), learned[0]).count() == 0 and X.learn(texts.limit(0), labels, "doc_id", "toxic", F.lit(True)).stems == {}


def test_learning(spark):
    texts = spark.createDataFrame([(i, ("grumph " if i % 4 == 0 else "") + passage(12)) for i in range(200)] + [(999, None)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (999, None), (3, 0)], "doc_id long, toxic int")
    grammar = X.learn(texts, labels, "doc_id", "toxic", F.lit(True))
    assert any("grumph".startswith(s) for s in grammar.stems)
    found = {r.doc_id: r.score for r in X.scores(texts, grammar).collect()}
    assert all((found[i] >= 0.5) == (i % 4 == 0) for i in range(200)) and 0 <= found[999] < 0.5
    assert X.learn(texts, labels.limit(0), "doc_id", "toxic", F.lit(True)).stems == {}
    plain = spark.createDataFrame([(i, passage(12)) for i in range(40)], DOCS)
    marks = spark.createDataFrame([(i, int(i < 2)) for i in range(40)], "doc_id long, toxic int")
    unknown = X.learn(plain, marks, "doc_id", "toxic", F.lit(True))
    assert unknown.stems == {} and all(r.score < 0.5 for r in X.scores(plain, unknown).collect())


def test_subsequence():
    for _ in range(100):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert D.common_subsequence(a, b) == table[-1][-1]


def test_contamination(spark):
    items = [(i, ". ".join([passage(12), passage(12), passage(8)])) for i in range(8)]
    rows = [(i, passage(150)) for i in range(40)]
    rows += [(100 + i, passage(60) + " " + x + " " + passage(50)) for i, x in items]
    loose = items[0][1].split()
    rows += [(200, passage(40) + " " + " ".join(w for k, w in enumerate(loose) if k % 8 != 5) + " " + passage(40)), (201, None), (202, ""), (None, items[1][1])]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame(items + [(50, None), (51, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert found == {(100 + i, i) for i in range(8)} | {(200, 0), (None, 1)}
    kept = [r.doc_id for r in D.decontaminated(docs, bench).collect()]
    assert sorted(x for x in kept if x is not None) == [*range(40), 201, 202]
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.com/x/", 10, {"etag": "1", "content-type": "t", "vary": "old"}),
        (2, "response", "https://a.com/x?utm_source=q", 90_000, {"etag": "2", "last-modified": "m"}),
        (3, "revisit", "http://a.com/x#f", 50, {"etag": "1", "vary": "new", "content-type": "other"}),
        (4, "revisit", "http://a.com/x", 200_000, {"last-modified": "m"}),
        (5, "revisit", "http://a.com/x", 10, {"etag": "1"}),
        (6, "revisit", "http://a.com/x", 90_001, {"etag": "1"}),
        (7, "revisit", "http://b.com/", 90_001, {}),
        (8, "revisit", None, 5, {"etag": "1"}),
        (9, "revisit", "http://a.com/x", 95_000, {"date": "d"}),
        (10, "request", "http://a.com/x", 95_000, {}),
    ]
    df = spark.createDataFrame(rows, "record_id long, type string, url string, time long, headers map<string,string>")
    found = {r.record_id: r for r in W.resolve_revisits(df, 1000).collect()}
    assert {k: (r.refers_to, r.status) for k, r in found.items()} == {3: (1, "resolved"), 4: (2, "resolved"), 5: (None, "no_response"), 6: (2, "mismatch"), 7: (None, "no_response"), 8: (None, "no_response"), 9: (2, "unchecked")}
    assert found[3].headers == {"etag": "1", "content-type": "t", "vary": "new"}
    assert W.resolve_revisits(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nhello"
    data = W.format_record("response", "http://a.com/", "2020-01-01T00:00:00Z", {"Content-Type": "application/http"}, block) + W.format_record("metadata", "http://a.com/", "2020-01-01T00:00:00Z", {}, b"k: v")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    found = W.read_warc(spark, str(tmp_path)).collect()
    assert len(found) == 4 and {bytes(r.payload) for r in found} == {b"hello", b"k: v"}
    assert {r.http_headers.get("etag") for r in found if r.record_type == "response"} == {"x"}


def exhaustive(rows, items):
    """(doc, item) by the checks alone, at every place of every text."""
    wanted = set()
    for doc, text in rows:
        w = (text or "").split()
        bag = set(w)
        for i, item in items:
            p = item.split()
            if sum(x in bag for x in p) < D.PARAPHRASE * len(p):
                continue
            answer = D.answer_of(item).replace(".", "").split()
            p = item.replace(".", "").split()
            for s in range(0, len(w), D.BLOCK):
                around = w[max(0, s - len(p)) : s + D.BLOCK * D.BLOCKS + len(p)]
                common = D.common_subsequence(p, around) / len(p)
                if common >= D.VERBATIM or common >= D.PARAPHRASE and D.common_subsequence(answer, around) / len(answer) >= D.ANSWER:
                    wanted.add((doc, i))
    return wanted


def test_contamination_by_paraphrases(spark):
    """Recall of at least 0.9 against exhaustive comparison where words are dropped, replaced and put in; benchmarks in parts; long and repeated rows."""
    own = random.Random(21)
    words = [f"p{i}" for i in range(3000)]
    some = lambda n: [words[min(2999, int(own.expovariate(1 / 400)))] for _ in range(n)]
    items = [(i, " ".join(some(22)) + " ".join(["", *some(22)]) + ". " + " ".join(some(10))) for i in range(60)]
    rows = [(i, " ".join(some(200))) for i in range(150)]
    for i, text in items:
        for kind in range(3):
            part = []
            for k, x in enumerate(text.replace(".", "").split()):
                chance = own.random() * (1 if k < 44 else 20)
                part += [] if kind != 1 and chance < 0.2 else some(1) if kind and chance < 0.3 else [x]
            rows.append((1000 + 10 * i + kind, " ".join(some(own.randint(0, 90)) + part + some(own.randint(0, 90)))))
    rows += [(5000, " ".join(some(20_000) + items[3][1].replace(".", "").split() + some(9000))), rows[-1]]
    wanted = exhaustive(rows, items)
    docs, bench = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", cosine int"), spark.createDataFrame(items, "item_id long, text string")
    for part in ((), (20,)):
        rows_found = D.contaminated(docs, bench, *part).collect()
        found = {(r.doc_id, r.item_id) for r in rows_found}
        assert len(wanted) > 100 and found <= wanted and len(found) >= 0.9 * len(wanted), (len(found), len(wanted))
        assert len(rows_found) > len(found)  # the repeated row
    kept = {r.doc_id for r in D.decontaminated(docs, bench, 20).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in found}


def test_contamination_of_large_benchmarks(spark):
    """A benchmark of far more passages than the space has dimensions: all that brute force finds is found."""
    own = random.Random(11)
    words = [f"x{i}" for i in range(6000)]
    some = lambda n: [own.choice(words) for _ in range(n)]
    items = [(i, " ".join(some(own.randint(15, 59)))) for i in range(1200)]
    rows = [(i, " ".join(some(120))) for i in range(60)]
    for i, text in items[::6]:
        part = [x for k, x in enumerate(text.split()) if i % 4 or k % 9 != 4]
        rows.append((1000 + i, " ".join(some(own.randint(0, 90)) + part + some(own.randint(0, 90)))))
    rows.append((5000, " ".join(some(5000) + items[3][1].split() + some(3000) + items[4][1].split())))
    wanted = exhaustive(rows, items)
    assert len(wanted) > 200
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == wanted


def test_html_sections():
    """Sections of other densities than the densest one stay, with and without an article element, and so do wrapped lists, tables and code."""
    dense = "".join(f"<p>{c * 499}.</p>" for c in "abcde")
    light = "".join(f"<p>{c * 99}.</p>" for c in "fghijklmno")
    rest = "<div><ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table><pre>x = 1</pre></div>"
    wanted = [x * 499 + "." for x in "abcde"] + [x * 99 + "." for x in "fghijklmno"] + ["one", "two", "cell", "x = 1"]
    inner = f"<section>{dense}</section><section>{light}</section>{rest}"
    links = "<div><a href=a>Home</a> <a href=b>News</a></div>"
    for page in (f"<article>{inner}</article>", f"<div>{inner}</div>", f"<main><div>{inner}</div></main>", f"<article><section>{dense}</section></article><article><section>{light}</section>{rest}</article>"):
        assert H.extract(f"<html><body>{links}{page}<footer>f</footer></body></html>").split("\n\n") == wanted
    assert H.extract(f"<body>loose<div>{dense}</div><div><p>short</p></div></body>").split("\n\n") == ["loose", *wanted[:5], "short"]


def test_html_names():
    """Class and id tokens that only contain a name of boilerplate, the page's wrapper, sections of the article and formulas stay."""
    p = lambda c, n=300: f"<p>{c * n}</p>"
    t = lambda *c: [x * 300 for x in c]
    side = "<div class='main-sidebar'><p>links</p></div><div id=siteFooter>f</div><div class='cookie-banner x'>c</div><div class=ad-slot>buy</div>"
    for wrapper in ("class='layout has-sidebar'", "id=page class='site no-banner'", "class=widget", "id=banner"):
        assert H.extract(f"<body><div {wrapper}>{p('a')}{p('b')}</div>{side}</body>").split("\n\n") == t("a", "b")
    parts = f"{p('a')}<section id=discussion>{p('b')}</section><section id='related-work'>{p('c')}</section>"
    assert H.extract(f"<body><article>{parts}</article>{side}").split("\n\n") == t("a", "b", "c")
    assert H.extract(f"<body><div>{parts}</div>{side}").split("\n\n") == t("a", "b", "c")
    talk = "<div id=discussion><div class=comment><p>me too</p></div><form><textarea>x</textarea></form></div><div class='comments-area'>no</div>"
    assert H.extract(f"<body><div>{p('a')}</div>{talk}").split("\n\n") == t("a")
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>"
    assert H.extract(f"<article>{p('a')}<p>where {math} holds</p></article>").split("\n\n") == [*t("a"), "where x=1 holds"]


def test_packing_equal_lengths():
    """Pieces of one length, all or a third of them, leave no more room than they must."""
    own = np.random.default_rng(3)
    mixed = lambda n: np.clip(own.lognormal(5.8, 0.9, n).astype(int), 2, 2048)
    assert len(np.unique(K.sum_of_squares(np.full(2000, 150), 2048)[0])) == -(-2000 // 13)
    for lengths in (np.r_[np.full(3000, 700), mixed(6000)], np.r_[np.full(3000, 300), own.integers(600, 1400, 6000)]):
        for pack in (K.sum_of_squares, K.best_fit, K.fewest):
            bins, offsets = pack(lengths, 2048)
            assert np.bincount(bins, lengths).max() <= 2048 and len(np.unique(bins)) == bins.max() + 1
            assert bins.max() + 1 <= 1.03 * -(-lengths.sum() // 2048)
            order = np.lexsort((offsets, bins))
            ends = (offsets + lengths)[order][:-1]
            assert (np.where(np.diff(bins[order]) > 0, 0, ends) == offsets[order][1:]).all()
        assert K.fewest(lengths, 2048)[0].max() <= min(K.sum_of_squares(lengths, 2048)[0].max(), K.best_fit(lengths, 2048)[0].max())
    assert len(K.fewest(np.zeros(0, np.int64), 2048)[0]) == 0


def test_archived_revisits(spark, tmp_path):
    """From files to resolved revisits: errors, parts and cut records between are no full responses; the profiles are told apart."""
    http = {"Content-Type": "application/http; msgtype=response"}
    same = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    not_modified = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    rows = [
        ("a", "response", 1, "200 OK", {"WARC-Payload-Digest": "sha1:X"}, "ETag: 1\r\nX-Kind: old"),
        ("b", "response", 2, "404 Not Found", {}, "ETag: 2"),
        ("c", "response", 3, "302 Found", {}, ""),
        ("d", "response", 4, "206 Partial Content", {}, "ETag: 1"),
        ("e", "response", 5, "503 Busy", {}, ""),
        ("f", "response", 6, "200 OK", {"WARC-Truncated": "length"}, "ETag: 3"),
        ("g", "revisit", 7, "304 Not Modified", {"WARC-Profile": not_modified}, "ETag: 1"),
        ("h", "revisit", 8, "200 OK", {"WARC-Profile": same, "WARC-Payload-Digest": "sha1:X"}, "ETag: 9\r\nX-Kind: new"),
        ("i", "revisit", 9, "200 OK", {"WARC-Profile": same, "WARC-Payload-Digest": "sha1:Y"}, "ETag: 1"),
    ]
    data = b"".join(W.format_record(kind, "http://a.com/", f"2020-01-01T00:00:0{t}Z", {**http, **more, "WARC-Record-ID": name}, f"HTTP/1.1 {code}\r\n{head}\r\n\r\nbody".encode()) for name, kind, t, code, more, head in rows)
    (tmp_path / "a.warc").write_bytes(data)
    read = W.read_warc(spark, str(tmp_path))
    assert [r.http_status for r in read.collect()] == [int(x[3][:3]) for x in rows]
    found = {r.record_id: r for r in W.resolve_revisits(W.archive_records(read)).collect()}
    assert {k: (r.refers_to, r.status) for k, r in found.items()} == {"g": ("a", "resolved"), "h": ("a", "resolved"), "i": ("a", "mismatch")}
    assert found["g"].headers == {"etag": "1", "x-kind": "old"} and found["h"].headers == {"etag": "9", "x-kind": "new"}
    assert found["g"].time == 1577836807


def test_jaccard_null_ids(spark):
    """A set that only rows without an id have links two documents that don't link by themselves."""
    words = [f"n{i}" for i in range(100)]
    edit = lambda w, *at: " ".join("e" if i in at else x for i, x in enumerate(w))
    other = [f"m{i}" for i in range(100)]
    rows = [(1, edit(words)), (None, edit(words, 30)), (None, edit(words, 30)), (2, edit(words, 30, 60)), (7, edit(other)), (None, edit(other, 50)), (None, passage(50))]
    sets = [shingle_set(t) for _, t in rows]
    alike = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[3]) and not alike(sets[0], sets[3]) and alike(sets[4], sets[5])
    found = J.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    key = lambda r: (r[0] or 0, r[1], r[2] or 0)
    assert sorted(map(tuple, found), key=key) == sorted(((d, len(x), c) for (d, _), x, c in zip(rows, sets, [1, 1, 1, 1, 7, 7, None])), key=key)


def test_html_offsets_and_references():
    page = "<p>" + "İ" * 40 + "</p><SCRIPT>x</ScRiPt><p>Second paragraph of the text.</p><p>a&<b>lt;</b> b &lt; c</p>"
    assert H.extract(page).split("\n\n") == ["İ" * 40, "Second paragraph of the text.", "a&lt; b < c"]
    for name in ("share-text", "tags-text", "related-text", "notice-text", "social-text"):
        one = f"<div class='{name}'><p>{'a' * 300}</p><p>{'b' * 300}</p></div>"
        assert H.extract(f"<body>{one}<nav><a href=x>y</a></nav></body>").split("\n\n") == ["a" * 300, "b" * 300]
        assert H.extract(f"<body>{one}<div><p>{'c' * 900}</p></div></body>").split("\n\n") == ["a" * 300, "b" * 300, "c" * 900]


def test_html_in_linear_time():
    import time

    for page in ("<div>" * 100_000 + "deep", "<b>x" * 100_000, "<span><p>x" * 50_000, "x</i>" * 100_000 + "<b>", "<a href=" * 100_000, "<li><b>x" * 50_000, "<!-- " * 50_000, '<a b="' * 50_000):
        start = time.process_time()
        text = H.extract(page)
        assert time.process_time() - start < 20, page[:20]
        assert text.replace("\n", "").count("x") == page.count("x") and ("deep" in text) == ("deep" in page)
    assert H.extract("a" * 2_000_000) == "a" * 2_000_000


def test_html_rows(spark):
    """Rows of any kind against the page's own extraction; empty tables; a column named like the result."""
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<p>a</p>", "u"), (3, "<p>a</p>", "u")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in H.main_text(pages).collect()) == [(1, ""), (2, ""), (3, "a"), (3, "a")]
    assert H.main_text(pages.limit(0)).count() == 0


def test_cut_archives(spark, tmp_path):
    """Gzip members one by one, cut files and broken members: what can be read is, and nothing crashes."""
    import gzip

    http = {"Content-Type": "application/http"}
    records = [W.format_record("response", f"http://a.com/{i}", "2020-01-01T00:00:00Z", http, b"HTTP/1.1 200 OK\r\n\r\n" + np.random.default_rng(i).bytes(100_000 if i == 2 else 300)) for i in range(4)]
    members = [gzip.compress(x) for x in records]
    whole = b"".join(members)
    assert [f["warc-target-uri"][-1] for f, _ in W.parse_records(whole)] == list("0123")
    assert [b for _, b in W.parse_records(whole)] == [b for x in records for _, b in W.parse_records(x)]
    cut = list(W.parse_records(whole[: len(members[0]) + len(members[1]) + 40_000]))
    assert len(cut) == 3 and 0 < len(cut[2][1]) < 100_000
    assert len(list(W.parse_records(members[0] + b"\x1f\x8bjunk" + members[1]))) == 1
    for n in range(0, len(members[0]), 7):
        assert len(list(W.parse_records(members[0][:n]))) <= 1
    (tmp_path / "a.warc.gz").write_bytes(whole[:-200])
    assert [r.truncated for r in W.read_warc(spark, str(tmp_path)).orderBy("url").collect()] == [False, False, False, True]


def test_revisits_of_odd_rows(spark):
    """Null times, repeated ids and ties."""
    rows = [(1, "response", "http://a.com/", 5, {"etag": "1"}), (2, "response", "http://a.com/", 5, {"etag": "2"}), (3, "revisit", "http://a.com/", None, {"etag": "1"}), (4, "revisit", "http://a.com/", 9, {"etag": "2"}), (4, "revisit", "http://a.com/", 9, {"etag": "2"}), (5, "response", "http://a.com/", None, {"etag": "9"})]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, type string, url string, time long, headers map<string,string>, status string")
    assert sorted((r.record_id, r.refers_to, r.status) for r in W.resolve_revisits(df).collect()) == [(3, None, "no_response"), (4, 2, "resolved"), (4, 2, "resolved")]


def test_images_of_many_kinds(spark):
    own = np.random.default_rng(1)
    colour = own.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (M.decode(M.encode_bmp(colour)) == colour).all()
    bmp = bytearray(M.encode_bmp(colour))
    bmp[28] = 16
    with pytest.raises(ValueError):
        M.decode(bytes(bmp))
    number = lambda x, size=4: x.to_bytes(size, "little")
    masks = number(0xFF) + number(0xFF00) + number(0xFF0000)
    fields = b"BM" + number(74) + bytes(4) + number(66) + number(40) + number(2) + number(1) + number(1, 2) + number(32, 2) + number(3) + bytes(20) + masks + bytes([1, 2, 3, 0, 4, 5, 6, 0])
    assert M.decode(fields).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert M.shades(b"P2 2 1 9 3 9").tolist() == [[85, 255]] and M.shades(b"P5 1 1 1023\n\x03\xff").tolist() == [[65535]] and M.shades(b"P1 2 1 1 0").tolist() == [[0, 255]]
    images = [(1, b"P5 2 2 65535\n" + bytes([1, 0] * 4)), (2, M.encode_bmp(colour)), (3, bytes(bmp)), (4, b"P2 2 2 3 3 3 3 3")]
    tiles = {r.id: r.tile and M.from_npy(r.tile) for r in M.image_tiles(spark.createDataFrame(images, "id int, image binary"), "image", 1, 1).collect()}
    assert tiles[1].tolist() == [[256]] and tiles[3] is None and tiles[4].tolist() == [[255]]
    assert abs(int(tiles[2][0, 0]) - (colour @ [0.299, 0.587, 0.114]).mean()) <= 0.5
    assert M.image_tiles(spark.createDataFrame([], "id int, image binary"), "image", 1, 1).count() == 0


def test_resize_in_bands(monkeypatch):
    tall = np.random.default_rng(2).integers(0, 256, (1000, 64)).astype(np.uint8)
    whole = M.area_resize(tall, 8, 9)
    for rows in (1, 7, 125, 999):
        monkeypatch.setattr(M, "BAND_ROWS", rows)
        assert M.area_resize(tall, 8, 9) == pytest.approx(whole)
    for height, width in ((1, 1), (3, 5), (7, 9)):
        exact = np.kron(tall[:50], np.ones((height, width))).reshape(height, 50, width, 64).mean((1, 3))
        assert M.area_resize(tall[:50], height, width) == pytest.approx(exact)
    assert M.difference_hash(np.zeros((200_000, 64), np.uint8)) == "0" * 16


def test_url_rules_in_many_files(tmp_path):
    """Rules dealt to files by their digests answer as one file does; long URLs and empty tables."""
    rules = [("block" if i % 3 else "allow", f"h{i}.org", "/" + "x" * (i % 5)) for i in range(500)]
    files = []
    for k, part in enumerate(U.index_parts(rules, 60)):
        files.append(str(tmp_path / str(k)))
        (tmp_path / str(k)).write_bytes(b"".join(part))
    U.build_index(rules, str(tmp_path / "all"))
    urls = [f"http://a.H{i}.org/{'x' * (i % 7)}/y" for i in range(600)] + ["http://h1.org/" + "x" * 100_000, None]
    assert len(files) == 9 and U.judge(U.Indexes(files), urls, "none") == U.judge(U.Indexes([str(tmp_path / "all")]), urls, "none")


def test_url_table(spark):
    assert U.url_verdicts(spark.createDataFrame([], "page_id long, url string"), U.RULES).count() == 0
    assert [r.verdict for r in U.url_verdicts(spark.createDataFrame([("http://a.com/" + "é" * 50_000,)] * 2, "url string"), ()).collect()] == ["allow"] * 2


def test_owner_rows():
    """Whatever a chunk pre-aggregates, the later entries are those of keys that a smaller owner has."""
    from tracklume.llm.shared_keys import owner_rows

    own = np.random.default_rng(4)
    for n in (0, 1, 300):
        keys, a, b = own.integers(0, 9, (n, 2)), own.integers(0, 6, n), own.integers(0, 3, n)
        values = np.arange(n)
        rows = owner_rows(keys, a, b, values).to_pylist()
        least = {}
        for k, x in zip(map(tuple, keys.tolist()), a.tolist(), strict=True):
            least[k] = min(least.get(k, x), x)
        told = {~r["v"] for r in rows if r["v"] < 0}
        assert told == {i for i in range(n) if a[i] > least[tuple(keys[i].tolist())]}
        asked = sorted(v for r in rows if r["v"] >= 0 for v in [r["v"], *(r["more"] or [])])
        assert asked == sorted(set(range(n)) - told) and len({(r["k"], r["l"], r["a"], r["b"]) for r in rows if r["v"] >= 0}) == sum(r["v"] >= 0 for r in rows)
