"""Token ids of texts by public tokenizers, a distinct word at a time.

Both tokenizers cut a text before they merge anything: what lies between two
such cuts gets the same ids wherever it stands.  So a worker encodes each word
once by the tokenizer's library and keeps its ids, in a table of bounded size.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

#: Words whose ids a worker keeps; beyond them the table is begun anew.
KEPT_WORDS = 400_000
#: Beyond these code points two libraries' tables of letters and digits might be of different Unicode versions.
_NEAR = "\\x00-\u024f\u2000-\u206f"
FAR = re.compile(f"[^{_NEAR}]")
#: Texts with more bytes between two white spaces go to the library as a whole.
_LONG_WORD = 4096


def _near_words() -> Callable[[str], list[str]]:
    """The words of byte-level BPE (``public_tokenizers.PATTERN``) of texts without FAR code points."""
    near = [chr(i) for i in (*range(0x250), *range(0x2000, 0x2070))]
    kind = lambda k: re.escape("".join(x for x in near if unicodedata.category(x)[0] == k))
    letter, number = kind("L"), kind("N")
    space = re.escape("\t\n\x0b\x0c\r\x85" + "".join(x for x in near if unicodedata.category(x)[0] == "Z"))
    marks = "'s|'t|'re|'ve|'m|'ll|'d"
    return re.compile(f"{marks}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall


class _Words(dict):
    """From a word to its ids; what is missing is encoded."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = tuple(self.encode(word))
        if len(word) <= _LONG_WORD:
            self[word] = ids
        return ids


def _stand_ins() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes: printable ones stand for themselves, the others are the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted({*range(256)} - {*printable})
    return {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}


@cache
def byte_level(path: str, special: bool) -> Callable[[str], list[int]]:
    """Ids of a text by a byte-level ``tokenizers`` file; where ``special``, the special tokens' strings get their ids, else they are plain text."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not special
    marks = sorted(x.content for x in whole.get_added_tokens_decoder().values()) if special else []
    encode = lambda x: whole.encode(x, add_special_tokens=False).ids
    # A word of the text is a word of the model: the way there, which cuts it into words again, can be left out.
    model, names = whole.model, {byte: c for c, byte in _stand_ins().items()}
    words, split = _Words(lambda x: [t.id for t in model.tokenize(x.encode().decode("latin-1").translate(names))]), _near_words()

    def run(text: str) -> list[int]:
        if (not text.isascii() and FAR.search(text)) or any(x in text for x in marks):
            return encode(text)
        return list(chain.from_iterable(map(words.__getitem__, split(text))))

    return run


@cache
def pieces(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by a ``sentencepiece`` model that puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    encode = lambda x: model.encode(x, num_threads=1)
    # A space can only begin a piece: so no merge crosses the start of a run of spaces.
    apart = not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    space = [model.piece_to_id("▁")]
    words, runs = _Words(lambda x: encode(x) if x else space), re.compile(" *[^ ]+| +").findall

    def run(text: str) -> list[int]:
        if not apart or "▁" in text:
            return encode(text)
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return list(chain.from_iterable(map(words.__getitem__, text.split(" ")))) if text else []
        # The space that the model puts before a text is the first of each run's.
        return list(chain.from_iterable(words[x[1:]] for x in runs(f" {text}")))

    return run


@cache
def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level ``tokenizers`` file."""
    from tokenizers import Tokenizer

    byte = _stand_ins()
    whole = Tokenizer.from_file(path)
    names = (whole.id_to_token(i) or "" for i in range(whole.get_vocab_size()))
    return [bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode() for x in names]


@cache
def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a ``sentencepiece`` model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i in range(model.get_piece_size()) for x in [model.id_to_piece(i)]]


#: Letters before U+0250, and ASCII that is neither a letter nor a space.
_LETTER, _MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-@\[-`{-~"
#: Where no token of either tokenizer goes on: before a space that follows no white space, between a letter and a mark, between a mark (no apostrophe) or a single line break and a letter.
_CUTS = rf"(?<=[!-~\u00a1-\u024f])(?= )|(?<=[{_LETTER}])(?=[{_MARK}])|(?<=[!-&(-@\[-`{{-~])(?=[{_LETTER}])|(?<=[!-~\u00a1-\u024f]\n)(?=[{_LETTER}])"
parts_of = re.compile(rf" ?[{_LETTER}]+(?=[ {_MARK}]|\Z)|(?s:.)+?(?:{_CUTS}|\Z)").findall
#: Parts, and ids of a side, that a worker keeps; beyond them the table is begun anew.
KEPT_PARTS, KEPT_IDS = 400_000, 4_000_000


class Parts(dict):
    """From a part of a text (see ``parts_of``) to its number; what is missing is encoded by both sides, and its ids are appended to theirs.

    Side A gives the ids of a text as it is, side B those of a space and the text.
    """

    def __init__(self, a: tuple[Callable[[str], list[int]], list[bytes]], b: tuple[Callable[[str], list[int]], list[bytes]]):
        super().__init__()
        self.encode, self.tables = (a[0], b[0]), (a[1], b[1])
        self.before = {x: len(b[0](x)) for x in ("a", ".")}
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.ids, self.ends, self.good = (array("q"), array("q")), (array("q", [0]), array("q", [0])), array("b")

    def add(self, part: str) -> int:
        a, b = self.encode
        # Side B puts a space: what begins without one is encoded behind a character that it can't be merged with.
        behind = "" if part[0] == " " else "." if part[0].isalpha() else "a"
        found = a(part), b(behind + part)[self.before[behind] :] if behind else b(part[1:])
        good = all(b"".join(map(table.__getitem__, x)) == part.encode() for x, table in zip(found, self.tables, strict=True))
        for ids, ends, new in zip(self.ids, self.ends, found, strict=True):
            ids.extend(new if good else ())
            ends.append(len(ids))
        self.good.append(good)
        return len(self.good) - 1

    def __missing__(self, part: str) -> int:
        number = self[part] = self.add(part)
        return number

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both sides' ids of a space and each text, and how many each has; none where a side's bytes are others."""
        if len(self) > KEPT_PARTS or max(map(len, self.ids)) > KEPT_IDS:
            self.begin()
        numbers, first = array("q"), [0]
        for text in texts:
            if text:
                whole = not text.isascii() and FAR.search(text)
                found = [self.add(f" {text}")] if whole else list(map(self.__getitem__, parts_of(f" {text}")))
                if not whole and not all(map(self.good.__getitem__, found)):
                    found = [self.add(f" {text}")]  # a part isn't given back: the libraries decide on the text
                numbers.extend(found)
            first.append(len(numbers))
        chosen, out = np.array(numbers, np.int64), []
        for ids, ends in zip(self.ids, self.ends, strict=True):
            ids, ends = np.array(ids), np.array(ends)
            size = ends[chosen + 1] - ends[chosen]
            after = np.r_[0, np.cumsum(size)]
            at = np.arange(after[-1]) + np.repeat(ends[chosen] - after[:-1], size)
            out += [ids[at], np.diff(after[first])]
        return tuple(out)


@cache
def divisible(path: str) -> bool:
    """Whether no piece of a ``sentencepiece`` model crosses one of the cuts of ``parts_of``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return not any("\u2581" in x.lstrip("\u2581") or any(map(str.isalpha, x)) and any(c.isascii() and not c.isalpha() for c in x) for x in own)
