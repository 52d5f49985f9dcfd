"""Language identification by compression.

Each language has a raw-content zstandard dictionary of two-word fragments.  A text is coded once
with each dictionary, in pieces so that the dictionary and not the text's own past decides, and the
smallest code names the language.  A narrow margin between the two smallest rejects the text.

A null text, or one without a letter, is ``und`` with score 0 and is rejected.  Ties go to the
language that sorts first and are rejected.  Without labelled rows every text is ``und``.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamwatch.llm.common import SPACE, packed, with_results

#: Labelled rows of each language that the dictionaries are made of.
SAMPLE_ROWS = 400
#: Fragments kept of each language, and bytes of its dictionary.
FRAGMENTS = 12_000
DICTIONARY_BYTES = 64 << 10
#: Bytes that are coded at a time.
PIECE = 2048
#: The least share by which the best code must be smaller than the next.
MARGIN = 0.0005
UNDECIDED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Dictionaries by language, from ``sample_rows`` whole texts of each (those of the least hash).

    What reaches the driver is bounded: FRAGMENTS fragments for each language.
    """
    keyed = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    cut = keyed.select("lang", "h", F.row_number().over(W.partitionBy("lang").orderBy("h")).alias("r")).where(F.col("r") <= sample_rows)
    texts = keyed.join(F.broadcast(cut.select("lang", "h").distinct()), ["lang", "h"])
    words = F.split(F.lower("text"), f"[{SPACE}]+")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0)), F.lit(2)), lambda i: F.array_join(F.slice("w", i + 1, 2), " "))
    found = texts.select("lang", words.alias("w")).select("lang", F.explode(pairs).alias("f")).where("f != ''").distinct()
    order = W.partitionBy("lang").orderBy(F.xxhash64("f"), "f")
    rows = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FRAGMENTS).orderBy("lang", "r").collect()
    joined: dict[str, list[str]] = {}
    for row in rows:
        joined.setdefault(row["lang"], []).append(row["f"])
    return {name: " ".join(found).encode()[:DICTIONARY_BYTES] for name, found in joined.items()}


class Coder:
    """One compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        params = zstandard.ZstdCompressionParameters(
            min_match=3, strategy=zstandard.STRATEGY_GREEDY, search_log=3, hash_log=15, chain_log=15, window_log=17,
            write_content_size=False, write_dict_id=False, write_checksum=False)
        self.coders = []
        for name in sorted(dictionaries):
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            self.coders.append((name, zstandard.ZstdCompressor(dict_data=content, compression_params=params)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.coders or not _LETTER.search(text):
            return UNDECIDED, 0.0
        data = text.lower().encode()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), name) for name, c in self.coders)
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def predictor(dictionaries: dict[str, bytes]):
    """Arrow UDF: text to (lang, score)."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        coder = _coder(dictionaries)
        found = [coder.predict(t.as_py()) for t in texts]  # one text at a time, not the batch
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return predict.asNondeterministic()  # never repeated by a pushed filter


_CODERS: dict[int, Coder] = {}


def _coder(dictionaries: dict[str, bytes]) -> Coder:
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(dictionaries)
    return _CODERS[key]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Documents with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``lang_rejected``."""
    rows = packed(docs, _p=predictor(dictionaries)(F.col(text)))
    found = rows.select(
        "_row", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"),
        ((F.col("_p.lang") == UNDECIDED) | (F.col("_p.score") < margin)).alias("lang_rejected"))
    return with_results(found, docs.columns, ["lang_pred", "score", "lang_rejected"])
