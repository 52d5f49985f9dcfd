"""Small awkward documents: nulls, empties, ties, repeats, very long texts and clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = {"en": "the of and house river stone light walk under green window water".split(),
         "fr": "le la des une maison rivière pierre lumière marcher sous fenêtre eau".split()}


def prose(seed: int, words: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "er", "ing", "ow", "ul", "as"]) + rng.choice(["", "", "t", "n"]) for _ in range(words))


def rows() -> list[tuple]:
    out = []
    for i in range(40):
        lang = "fr" if i % 4 == 0 else "en"
        out.append((i, prose(i, 60, lang), lang, "a" if i % 3 else "b"))
    base = prose(100, 80)
    near = base.split()
    near[40] = "changed"
    out += [(50, base, "en", "a"), (51, base, "en", "a"), (52, " ".join(near), "en", None), (53, base.upper(), None, "b")]
    out += [(60, None, "en", "a"), (61, "", None, None), (62, " \n\t ", "en", "a"), (63, "one", "en", "b"), (64, "12345 67", "en", "b")]
    out += [(None, base, "en", "a"), (None, None, None, None), (70, "same row", "en", "a"), (70, "same row", "en", "a")]
    out.append((80, "\n".join([prose(7, 12)] * 3 + ["x" * 45, prose(8, 4000)]), "en", "a"))
    out += [(81 + i, f"{prose(200 + i, 20)}\n  {prose(7, 12).title()} \n{prose(300 + i, 20)}", "en", "b") for i in range(6)]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in out]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
