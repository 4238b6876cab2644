"""A small table with everything that a documents table can hold wrong."""
import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, mark string, fp long, h long, score double, line int, part int"


def make_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    words = [f"w{k}" if k % 3 else f"Wört{k}" for k in range(300)]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(1, 30)))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 6))) for _ in range(n)]
    for k in range(n // 4):                                             # near copies: a word changed
        copy = texts[k].split(" ")
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += texts[:5]                                                  # exact copies
    texts += ["passage " + texts[7] + " end", "THE!! THE!! LOUD!!\n" + texts[3].upper()]
    return texts


@pytest.fixture(scope="session")
def messy_rows():
    """(doc_id, text, lang, source) with nulls in every column, empty, blank, long and repeated texts, and repeated ids."""
    texts = make_texts(5, 60)
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else "s0") for k, t in enumerate(texts)]
    rows += [(900, None, "en", "s0"), (901, "", None, "s1"), (902, " \n\t \n", "en", None), (None, "no id here at all", "en", "s0"), (None, None, None, None),
             (903, "x" * 30_000 + " tail", "en", "s0"), (904, " ".join(f"long{k % 977}" for k in range(9_000)), "en", "s2"),
             (905, "same row", "en", "s0"), (905, "same row", "en", "s0"), (906, "one text", "en", "s0"), (906, "another text of this id", "en", "s1"),
             (907, "a\x1cb c d Über <|endoftext|>mid ΣΣ İx Å é", "el", "s1"), (908, "\n\n\n", "en", "s1"), (-3, texts[0], "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    rows = [(i, t, lang, s, None if t is None else len(t), 7, "clash", 1, 2, 0.5, 3, None) for i, t, lang, s in messy_rows]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
