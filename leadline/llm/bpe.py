"""Byte-pair encoding and decoding with a given vocabulary and merge list."""
from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, memo

#: Runs in each generation of a worker's memo (and a third as many pieces), so memory stays bounded whatever the vocabulary.
MEMO = 180_000
#: Longer strings are encoded each time: they hardly come twice.
MEMO_LENGTH = 64
# White space as the tokenizer's patterns see it, and four separators that only Python counts as white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = "\x1c\x1d\x1e\x1f"
SPACE_RUNS = regex.compile(f"[^{SPACE}]+")


def has_odd_space(text: str) -> bool:
    return any(c in text for c in NOT_SPACE)


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class _Memo(dict):
    """Fills itself, in two generations: when the young one is full it becomes the old one, which is then forgotten.

    What is asked for again in time moves back to the young generation, so frequent words always stay.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Bpe:
    """A tokenizer file of the kind: special tokens, NFC, white space, lower case, a split pattern, bytes, merges with word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [p["type"] for p in pre]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError("this tokenizer file has parts that the encoder does not know")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        #: For each id, what it merges with: the neighbour's id to rank and new id.
        self.merges: list[dict[int, tuple[int, int]]] = [{} for _ in range(max(self.strings) + 1)]
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[left]][self.ids[right]] = rank, self.ids[left + right]
        self.split = regex.compile(pre[0]["pattern"]["Regex"].replace(r"\s", SPACE))
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = _Memo(self._piece, MEMO // 3)
        self.words = _Memo(self._word, MEMO)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge neighbours by rank, the leftmost first among equals.

        The symbols form a doubly linked list; a priority queue holds the mergeable pairs by rank and place. A merge leaves
        stale entries in the queue, which are recognised when they come up: their place is dead, or the pair that now
        begins there has another rank.
        """
        n, merges = len(symbols), self.merges
        if n == 1:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        shift = n.bit_length()
        place = (1 << shift) - 1
        queue = [m[0] << shift | i for i in range(n - 1) if (m := merges[symbols[i]].get(symbols[i + 1]))]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & place
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges[symbols[i]].get(symbols[j])
            if found is None or found[0] != entry >> shift:
                continue
            new = symbols[i] = found[1]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges[new].get(symbols[k]):
                    heappush(queue, m[0] << shift | i)
            if (h := before[i]) >= 0 and (m := merges[symbols[h]].get(new)):
                heappush(queue, m[0] << shift | h)
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece of the split pattern. A byte that the vocabulary lacks gives none."""
        symbols = [self.symbols[b] for b in piece.encode("utf-8", "replace")]
        symbols[-1] += self.suffix
        known = [self.ids[s] for s in symbols if s in self.ids]
        return self.merge(known) if known else []

    def _word(self, word: str) -> tuple[bytes, str]:
        """Ids, as 32-bit integers, and decoded form of a run without white space: pieces never cross white space."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")  # each letter by itself: no final sigma
        plain = word.lower()
        ids = self.pieces[plain] if plain.isalpha() else [i for piece in self.split.findall(plain) for i in self.pieces[piece]]
        return array("i", ids).tobytes(), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings behind each other, a space between them, as the file names no decoder of its own."""
        return " ".join(map(self.strings.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text, as 32-bit integers, and the text that they decode to."""
        parts: list[tuple[bytes, str]] = []
        at = 0
        for mark in self.marks.finditer(text) if self.marks and "<" in text else ():
            parts += self._words(text[at:mark.start()])
            number = self.special[mark[0]]
            parts.append((array("i", [number]).tobytes(), self.strings[number]))
            at = mark.end()
        parts += self._words(text[at:] if at else text)
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[0]])

    def _words(self, text: str) -> list[tuple[bytes, str]]:
        return list(map(self.words.__getitem__, SPACE_RUNS.findall(text) if has_odd_space(text) else text.split()))


def loaded(text: str) -> Bpe:
    """One encoder, with its memos, for all tasks of this operator that a worker runs."""
    return memo((Bpe, text), lambda: Bpe(text))


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array of integers) and decoded (text) of every whole text, with the columns named in `keep`.

    tokenizer: the path of a tokenizer file, read once by the driver; its content (a fixed size, under 2 MB) goes to the
    workers as a broadcast variable. One pass over the table without a shuffle. A worker keeps a bounded memo of words.

    Null or empty text, or white space only: no ids and an empty decoded text. Strings of special tokens within a text
    become those tokens. Repeated rows and null ids stay as they are. An empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    names = [f"__keep_{k}" for k in range(len(keep))]
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(content.value)
        for part in chunks(batches, keep=True):
            made = [encoder.encode(t) for t in part.column("text").to_pylist()]
            sizes = np.cumsum([0] + [len(m[0]) // 4 for m in made]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join([m[0] for m in made]), np.int32)))
            columns = {"doc_id": part.column("doc_id"), "ids": ids, "decoded": pa.array([m[1] for m in made], pa.string())}
            yield pa.record_batch(columns | {n: part.column(n) for n in names})

    kinds = {n: slim.schema[n].dataType.simpleString() for n in names}
    made = slim.mapInArrow(run, "doc_id long, ids array<int>, decoded string" + "".join(f", {n} {kinds[n]}" for n in names))
    return made.select("doc_id", "ids", "decoded", *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)])

