"""Small tables with the awkward cases every operator has a defined result for."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHING = {"row": "'r'", "kept": "true", "fp": "7L", "size": "'x'", "score": "0.5", "spans": "array(1)", "c": "1",
            "best": "'b'", "times": "9", "base": "0", "fit": "'f'", "tokens": "array('t')", "x0": "1.5", "key": "'k'"}


def words(rng: random.Random, n: int, lang: str = "en") -> str:
    parts = {"en": ["the", "of", "tion", "ing", "er", "an", "wh"], "de": ["der", "und", "sch", "keit", "ung", "ü"],
             "fr": ["le", "que", "eau", "ment", "é", "oi"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "de", "fr"])
        text = words(rng, rng.randint(55, 160), lang)
        out.append((i, text, lang, f"src{rng.randint(0, 2)}", len(text)))
    return out


def awkward() -> list[tuple]:
    """Null columns, empty and blank texts, one word, a long text, ties and repeated rows."""
    rng = random.Random(5)
    long_text = words(rng, 12_000)
    same = words(rng, 80)
    return [(1000, None, "en", "src0", None), (1001, "", "de", "src1", 0), (1002, " \n\t ", None, "src0", 4),
            (1003, "word", "en", None, 4), (1004, long_text, "en", "src0", len(long_text)),
            (None, same, "fr", "src1", len(same)), (None, None, None, None, None),
            (1005, same, "en", "src0", len(same)), (1005, same, "en", "src0", len(same)),
            (1006, same, "en", "src2", len(same)), (1007, "é ñ ß 日本 😀 #$%&|<>", "de", "src1", 19)]


def documents(spark, data: list[tuple], clashing: bool = True):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    if clashing:
        for name, value in CLASHING.items():
            df = df.selectExpr("*", f"{value} AS {name}")
    return df


def save(spark, root: str, **tables) -> str:
    """Write tables as <root>/<name>.parquet and return the folder."""
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return root
