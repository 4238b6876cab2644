"""Language of texts by compression: the language whose dictionary makes a text smallest."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, texts

#: Pieces of text that a dictionary holds at most, one from each of as many hash buckets of a language's texts.
PIECES = 256
#: Characters of a piece. A dictionary has PIECES * PIECE_CHARS characters at most.
PIECE_CHARS = 500
#: Languages that are told apart at most; more are refused with an error, as every text is encoded once for each.
LANGUAGES = 200
#: A text is encoded in parts of so many bytes, so that a long one learns from the dictionary rather than from itself.
PART = 4096
LEVEL = 5
#: Weight of a byte that another language needs more, in the score.
SHARPNESS = 0.25
#: A prediction is rejected if the second language needs less than this share of bytes more.
MARGIN = 0.005
UNDETERMINED = "und"

# ASCII letters in lower case and non-ASCII bytes stay, all other bytes become blanks.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LOWER[0x61:0x7B]
LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS = LETTERS.tobytes()


def plain(text: str) -> bytes:
    """The words of letters in lower case, single blanks between and around them."""
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


@dataclass
class Dictionaries:
    """Languages, the commonest first, and the raw content of each one's dictionary."""
    names: list[str]
    content: list[bytes]

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in self.content:
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PART, dict_size=len(content), write_content_size=0, write_dict_id=0, write_checksum=0,
                                                                 format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            raw.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=how))
        return made


def encoded_sizes(text: bytes, encoders: list[zstandard.ZstdCompressor]) -> list[int]:
    parts = [text[k:k + PART] for k in range(0, len(text), PART)]
    return [sum(len(e.compress(p)) for p in parts) for e in encoders]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no dictionary may hold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Dictionaries:
    """Dictionaries of all languages that rows outside the held-out fifth are labelled with.

    A language's texts are dealt to PIECES buckets by a hash, and the text with the smallest hash of each gives a piece of
    PIECE_CHARS characters from a hashed place: one aggregate, combined before the shuffle, in which copies count once. The
    driver receives at most PIECES * PIECE_CHARS characters a language. Rows with a null id, text or language teach nothing,
    nor do languages without a letter.
    """
    known = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    dealt = known.withColumns({"h": F.xxhash64("text"), "at": F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - PIECE_CHARS, F.lit(0)) + 1)})
    dealt = dealt.select("lang", "h", F.pmod("h", F.lit(PIECES)).alias("bucket"), F.expr(f"substr(text, cast(at as int) + 1, {PIECE_CHARS})").alias("piece"))
    rows = dealt.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "piece")).alias("first"))
    rows = rows.select("lang", "n", "first.*")
    found = rows.groupBy("lang").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("h", "piece"))).alias("pieces"))
    names = found.count()
    if names > LANGUAGES:
        raise ValueError(f"{names} languages, {LANGUAGES} can be told apart")
    made = [(r.n, r.lang, b"".join(plain(p.piece) for p in r.pieces)) for r in found.collect()]
    made = sorted((x for x in made if x[2].strip()), key=lambda x: (-x[0], x[1]))
    return Dictionaries([x[1] for x in made], [x[2] for x in made])


def detect_languages(docs: DataFrame, model: Dictionaries, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), lang, nearest, score, margin and sizes of every whole text.

    The words of letters are encoded by zstandard with each language's dictionary as raw content, in parts of PART bytes, each
    from a fresh state. `nearest` is the language with the smallest total (ties: the commoner one), null if the text has no
    letter or no language is known. `margin` is the share of bytes that the second saves against it; `lang` is the nearest one,
    or `und` where there is none or the margin is too narrow. `score` (0 to 1) falls with the closeness of all others and is 0
    without a nearest language. `sizes` follows the model's order of languages.

    One pass without a shuffle; the model is a dictionary of some 130 KB a language. Null, empty and letterless texts are
    undetermined. Very long texts are encoded part by part. Repeated rows and null ids stay as they are. An empty table gives
    no rows. Other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, encoders = sent.value.names, sent.value.encoders()
        for part in chunks(batches):
            column = part.column("text")
            letters = pc.match_substring_regex(column, r"\p{L}").to_pylist()
            sizes = [encoded_sizes(plain(t), encoders) if known and names else None for t, known in zip(column.to_pylist(), letters, strict=True)]
            nearest, score, gap = [], [], []
            for s in sizes:
                best = min(range(len(s)), key=s.__getitem__) if s else None
                nearest.append(None if best is None else names[best])
                score.append(1 / sum(np.exp(SHARPNESS * (s[best] - x)) for x in s) if s else 0.0)
                others = [x for k, x in enumerate(s or ()) if k != best]
                gap.append((1 - s[best] / min(others) if others else 1.0) if s else 0.0)
            lang = [UNDETERMINED if n is None or g < margin else n for n, g in zip(nearest, gap, strict=True)]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "mark": part.column("mark"), "lang": pa.array(lang, pa.string()), "nearest": pa.array(nearest, pa.string()),
                                   "score": pa.array(score, pa.float64()), "margin": pa.array(gap, pa.float64()), "sizes": pa.array(sizes, pa.list_(pa.int64()))})

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, mark long, lang string, nearest string, score double, margin double, sizes array<long>")
