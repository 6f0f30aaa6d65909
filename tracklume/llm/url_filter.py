"""URL rules in a sorted array of 64-bit digests, probed by vectorised binary search.

A rule is a host and a path prefix.  The index file holds the rules' xxhash64
digests in order, the offsets of their strings and the strings themselves;
workers map it into memory.  A probe looks up, for each URL, every (suffix of
the host's labels, prefix of the path as long as some rule's path); a digest
that is found counts only if the stored string is equal, so collisions of
digests change nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from tracklume.llm.scratch import Scratch

#: Rules of one index file, about: more are dealt to several files by the first bits of their digests.
FILE_RULES = 20_000_000
_MAGIC = np.uint64(0x1D5)
_SCHEMA = "host string, path string, rule string, verdict string"


def index_parts(rules: Iterable[tuple[str, str, str]], file_rules: int = FILE_RULES) -> Iterator[Iterator[bytes]]:
    """The files of an index of (verdict, host, path prefix) rules, each as pieces of bytes; a (host, path) given twice keeps its first verdict."""
    seen: dict[bytes, int] = {}
    lengths: set[int] = set()
    for verdict, host, path in rules:
        seen.setdefault(f"{host}{path}".encode(), int(verdict == "block"))
        lengths.add(len(path))
    digests = np.array([xxhash.xxh64_intdigest(x) for x in seen], np.uint64)
    strings, verdicts = np.array([*seen, None], object)[:-1], np.array(list(seen.values()), np.uint64)
    order = np.argsort(digests, kind="stable")
    sizes = np.array(sorted(lengths), np.uint64)
    files = max(1, -(-len(seen) // file_rules))
    for part in np.split(order, np.searchsorted(digests[order], _borders(files))):
        ends = np.cumsum([0, *map(len, strings[part])]).astype(np.uint64)
        head = np.array([_MAGIC, len(part), len(sizes)], np.uint64)
        yield (x.tobytes() if isinstance(x, np.ndarray) else x for x in (head, sizes, digests[part], verdicts[part], ends, *strings[part]))


def _borders(files: int) -> np.ndarray:
    """Least digests of the files but the first."""
    return (np.arange(1, files, dtype=object) * (1 << 64) // files).astype(np.uint64)


def build_index(rules: Iterable[tuple[str, str, str]], file: str) -> None:
    """Writes the index of all rules as one file."""
    with open(file, "wb") as out:
        for part in index_parts(rules, 1 << 62):
            out.writelines(part)


class Index:
    """An index file, mapped: nothing of it is read before it is probed."""

    def __init__(self, file: str):
        numbers = np.memmap(file, np.uint64, "r", shape=(os.path.getsize(file) // 8,))
        assert numbers[0] == _MAGIC, "not a rule index"
        n, sizes = int(numbers[1]), int(numbers[2])
        cuts = np.cumsum([3, sizes, n, n, n + 1])
        self.lengths, self.digests, self.blocks, self.ends = (numbers[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        self.strings = np.memmap(file, np.uint8, "r")[cuts[-1] * 8 :]

    def find(self, keys: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """The place of each key among the rules, -1 where it is none."""
        digests = np.array([xxhash.xxh64_intdigest(x) for x in keys], np.uint64) if digests is None else digests
        at = np.searchsorted(self.digests, digests)
        found = np.full(len(keys), -1)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests) if len(self.digests) else ():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == digests[i]:  # equal digests stand together
                if self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found


class Indexes:
    """Index files of one set of rules; a key is looked up in the file of its digest."""

    def __init__(self, files: list[str]):
        self.files = [Index(x) for x in files]
        self.lengths = self.files[0].lengths

    def blocks(self, keys: list[bytes]) -> list[bool | None]:
        """Whether the rule of each key blocks; None where it is none."""
        digests = np.array([xxhash.xxh64_intdigest(x) for x in keys], np.uint64)
        file = np.searchsorted(_borders(len(self.files)), digests, "right")
        out: list[bool | None] = [None] * len(keys)
        for k, index in enumerate(self.files):
            mine = np.flatnonzero(file == k)
            found = index.find([keys[i] for i in mine], digests[mine])
            for i, place in zip(mine[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
                out[i] = bool(index.blocks[place])
        return out


_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def judge(index: Indexes, urls: list[str | None], default: str) -> tuple[list, list, list, list]:
    """Host, path, rule and verdict of each URL: the longest rule that fits, else ``default``."""
    parts = [split_url(x) for x in urls]
    places: dict[bytes, int] = {}  # each distinct key is hashed and probed once
    keys, owner = [], []
    lengths = [int(x) for x in index.lengths]
    for i, (host, path) in enumerate(parts):
        labels = host.split(".")
        hosts = [".".join(labels[j:]) for j in range(len(labels))]
        for n in lengths:
            if n <= len(path):
                keys += [places.setdefault(f"{h}{path[:n]}".encode(), len(places)) for h in hosts]
                owner += [i] * len(hosts)
    rules: list[str | None] = [None] * len(urls)
    verdicts = [default] * len(urls)
    distinct = list(places)
    found = index.blocks(distinct)
    for k, i in zip(keys, owner, strict=True):
        if found[k] is not None and (rules[i] is None or len(distinct[k].decode()) > len(rules[i])):
            rules[i], verdicts[i] = distinct[k].decode(), "block" if found[k] else "allow"
    return [x for x, _ in parts], [x for _, x in parts], rules, verdicts


def url_verdicts(urls: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (null where none fits) and verdict.

    The index is built once, written to the shared folder and handed to each
    executor as files; URLs are judged where they are read, without a shuffle.
    Null or malformed URLs have an empty host and path and get ``default``.
    Columns named like the four results are replaced.
    """
    spark: SparkSession = urls.sparkSession
    scratch = Scratch(spark, "rules")
    names = []
    for k, part in enumerate(index_parts(rules)):
        path = scratch.write_bytes(part, f"{k}.idx")
        spark.sparkContext.addFile(path)
        names.append(path.rpartition("/")[2])
    kept = urls.drop("host", "path", "rule", "verdict")
    places = [x for x in kept.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Indexes([SparkFiles.get(x) for x in names])
        for batch in batches:
            judged = judge(index, batch.column(places.index(url)).to_pylist(), default)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in judged)], names=[*places, "host", "path", "rule", "verdict"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), _SCHEMA])
    return kept.mapInArrow(run, schema)


#: The rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
