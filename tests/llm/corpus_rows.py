"""Small tables for the corpus operators: ordinary text, and every awkward row."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns whose names an operator might use itself
CLASHING = ("kept", "size", "row", "fp", "key", "words", "start", "rank", "__id", "place")

_SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "ich sch ein ung ver ß ö ü gen heit".split()}


def prose(rng, n, lang="en"):
    parts = _SYLLABLES[lang]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n)]
    for i in range(7, n, 11):
        words[i] += ".\n" if i % 2 else ","
    return " ".join(words)


def rows(seed=5, n=60):
    """Ordinary documents with copies, near copies, shared passages and lines, then odd ones."""
    rng = random.Random(seed)
    shared = prose(rng, 120)
    out = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        text = prose(rng, rng.randint(30, 260), lang)
        if i % 7 == 1:
            text = text + "\n" + shared + "\n" + prose(rng, 20, lang)
        if i % 9 == 4 and out:
            text = out[-2][1]
        if i % 9 == 5 and out:
            text = (out[-3][1] or "").replace(" ", "  ", 3)
        if i % 5 == 0:
            text = "Subscribe to our letter\n" + text
        out.append((i, text, lang, "hot" if i % 3 else f"s{i % 4}"))
    odd = [
        (1000, None, "en", "hot"), (1001, "", "de", None), (1002, "  \n\t ", None, "s1"),
        (1003, "one", None, None), (1004, "12 34 !!", "en", "s1"), (1005, "ab " * 3000, "en", "hot"),
        (1006, "Ünï¢ödé ÉÀ ß 日本語  x", "de", "s2"), (1007, "a\x00b \x0b c\r\nd", "en", "s2"),
        (1008, "\n\n\n", "en", "s3"), (1009, prose(rng, 4000), "en", "s0"), (1003, "one", None, None),
        (None, "no id " * 40, "en", "hot"), (None, "no id " * 40, "en", "hot"), (7, "same id, other text", "en", "s1"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in out + odd]


def unique(all_rows):
    """The rows whose id is theirs alone."""
    ids = [r[0] for r in all_rows]
    return [r for r in all_rows if r[0] is not None and ids.count(r[0]) == 1]


def table(spark, some, clashing=False):
    df = spark.createDataFrame(some, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"my {c}") for c in CLASHING})
    return df
