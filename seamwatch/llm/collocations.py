"""Phrase collocations by prefix-free parsing.

Texts are cut at punctuation into pieces of words.  A piece is parsed into chunks: a window of four
words whose hash is divisible by ``PERIOD`` ends one chunk and begins the next, so both hold it and
equal passages fall into equal chunks wherever they stand.  Each distinct chunk is kept once with the
number of times the parse uses it (and ``extra``, how many of its last words the next chunk owns).

Phrases of one to five words are counted in the distinct chunks alone, weighted by that number; a
phrase counts in the chunk that owns its first word, and the four shared words are enough to hold the
rest, so overlaps count once and the counts are those of the whole text.  A phrase can only be
frequent if its two parts of one word less are, so each length first looks both up in a bit filter of
the frequent ones (no false negatives, a size of ``FILTER_BITS`` at most); the exact counts follow.

A null text is empty, a null language is ``und``; rows of one id count apart; very long pieces are cut
into chunks of ``LONGEST`` words, with the same overlap.  Equal scores rank by count, then by the
phrase's UTF-8 bytes.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamwatch.llm.common import BYTE_CODES, _powers, byte_views, durable, exact_quotient, mix, sized, whole

WORDS = 5
LEAST = 100
TOP = 2000
#: Words that neighbouring chunks share: enough for every phrase that begins before them.
SHARED = WORDS - 1
PERIOD = 16
LONGEST = 512
#: Text bytes that a task parses or counts at once.
PARSE_BYTES = 1 << 22
COUNT_BYTES = 1 << 23
FILTER_BITS = 1 << 27
#: Bits of the filter for each entry.
BITS_EACH = 32
#: Parts that the counts of a popular first or last word are dealt into.
LANES = 16
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: A-Z as a-z, tabs as spaces, all marks that end a piece as full stops.
_TEXT_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: a sum of byte codes times powers of an odd number, moved to the word's start."""
    data, offsets = byte_views(words)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=total[1:])
    start, stop = offsets[:-1], offsets[1:]
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


class Words:
    """The words of rows end to end: distinct ones, the number of each word among them, and the row and end of row of each."""

    def __init__(self, rows: pa.Array):
        each = pc.split_pattern(rows, " ")
        coded = each.flatten().dictionary_encode()
        self.distinct, self.ids = coded.dictionary, coded.indices.to_numpy()
        stops = each.offsets.to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), np.diff(stops))
        self.end = np.repeat(stops[1:], np.diff(stops))
        self.first = stops[:-1]

    def __len__(self) -> int:
        return len(self.ids)

    def hashes(self) -> np.ndarray:
        return _hashes(self.distinct)[self.ids]

    def joined(self, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
        """The words from each start to its stop, with single spaces."""
        sizes = stops - starts
        to = np.cumsum(sizes)
        at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(starts - to + sizes, sizes)
        values = self.distinct.take(pa.array(self.ids[at]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]), pa.int32()), values), " ")


def parse(pieces: list[bytes], period: int = PERIOD, longest: int = LONGEST) -> tuple[pa.Array, np.ndarray]:
    """Chunks of pieces, and the ``extra`` of each."""
    rows = pa.array(pieces, pa.string())
    rows = pc.ascii_trim(pc.replace_substring_regex(rows, " {2,}", " "), " ")
    words = Words(rows.filter(pc.greater(pc.binary_length(rows), 0)))
    n = len(words)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    hashes = words.hashes()
    window = np.zeros(n, np.uint64)
    for i in range(SHARED):
        window = mix(window * _MUL + np.concatenate([hashes[i:], np.zeros(min(i, n), np.uint64)])[:n])
    start = (window % np.uint64(period) == 0) & (np.arange(n) + SHARED <= words.end)
    start[words.first] = True
    starts = np.flatnonzero(start)
    stops = np.append(starts[1:], n)
    if (stops - starts).max() > longest:
        starts = np.concatenate([np.arange(a, b, longest) for a, b in zip(starts, stops, strict=True)])
        stops = np.append(starts[1:], n)
    shown = np.minimum(stops + SHARED, words.end[starts])
    return words.joined(starts, shown), shown - stops


def dictionary(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, chunk, extra, uses): the distinct chunks of the parse of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}

        def parsed() -> Iterator[pa.RecordBatch]:
            for name, pieces in waiting.items():
                chunks, extra = parse(pieces)
                found = pa.table({"chunk": chunks, "extra": pa.array(extra, pa.int32())}).group_by(["chunk", "extra"]).aggregate([([], "count_all")])
                yield from pa.table({"lang": pa.array([name] * found.num_rows, pa.string()), "chunk": found["chunk"], "extra": found["extra"], "uses": found["count_all"]}).to_batches()
            waiting.clear()

        size = 0
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                raw = (value.as_py() or "").encode().translate(_TEXT_BYTES)
                waiting.setdefault(name.as_py(), []).extend(raw.split(b"."))
                size += len(raw)
                if size >= PARSE_BYTES:
                    yield from parsed()
                    size = 0
        yield from parsed()

    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    parts = own.mapInArrow(run, "lang string, chunk string, extra int, uses long")
    return parts.groupBy("lang", "chunk", "extra").agg(F.sum("uses").alias("uses"))


def _lang_hash(names: list[str]) -> np.ndarray:
    return mix(_hashes(pa.array(names, pa.string())) + np.uint64(1))


def _grown(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return mix(grams * _MUL + words)


class BitFilter:
    """Two bits for each phrase hash; tells for sure which phrases were never added."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    def _places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for h in (hashes, mix(hashes)):
            at = h % np.uint64(self.bits)
            yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        for word, bit in self._places(hashes):
            np.bitwise_or.at(self.words, word, bit)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for word, bit in self._places(hashes):
            out &= (self.words[word] & bit) != 0
        return out


def frequent_filter(frequent: DataFrame, most_bits: int = FILTER_BITS) -> BitFilter:
    """The filter of all (lang, phrase), phrases of one length; tasks send the set words of their part, which are joined by OR."""
    bits = 1 << 16
    while bits < min(most_bits, BITS_EACH * frequent.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BitFilter(bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = Words(batch.column(1))
            one = mix(words.hashes() ^ _lang_hash(batch.column(0).to_pylist())[words.row])
            grams, length = one[words.first], len(words) // batch.num_rows
            for k in range(1, length):
                grams = _grown(grams, one[words.first + k])
            own.add(grams)
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.words[at].view(np.int64))], ["word", "bits"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return BitFilter(bits, words)


def _known(words: Words, langs: pa.DictionaryArray, length: int, filter_: BitFilter) -> np.ndarray:
    """Whether the filter holds the phrase of ``length`` words at each place (at the end of a row, of fewer rows)."""
    of_row = _lang_hash(langs.dictionary.to_pylist())[langs.indices.to_numpy()]
    one = mix(words.hashes() ^ of_row[words.row])
    grams = one
    for k in range(1, length):
        grams = _grown(grams[: len(one) - k], one[k:])
    return filter_.holds(grams)


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= COUNT_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def chunks_with_neighbours(chunks: DataFrame, parts: BitFilter, length: int) -> DataFrame:
    """The chunks that hold two neighbouring phrases of ``length`` words of the filter; no other can hold a longer one that counts."""
    shared = chunks.sparkSession.sparkContext.broadcast((parts.bits, parts.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = BitFilter(*shared.value)
        for table in _by_size(batches):
            words = Words(table["chunk"].chunk(0))
            known = _known(words, table["lang"].chunk(0).dictionary_encode(), length, filter_)
            at = np.flatnonzero(known[:-1] & known[1:])
            at = at[at + length + 1 <= words.end[at]]
            keep = np.zeros(table.num_rows, bool)
            keep[words.row[at]] = True
            yield from table.filter(pa.array(keep)).to_batches()

    return chunks.mapInArrow(run, chunks.schema)


def count_phrases(chunks: DataFrame, length: int, parts: BitFilter | None) -> DataFrame:
    """(lang, phrase, f) of all phrases of ``length`` words whose parts of one word less the filter holds."""
    shared = chunks.sparkSession.sparkContext.broadcast((parts.bits, parts.words)) if parts else None

    def counted(table: pa.Table, filter_: BitFilter | None) -> pa.RecordBatch:
        langs = table["lang"].chunk(0).dictionary_encode()
        of_chunk = langs.indices.to_numpy()
        uses, extra = table["uses"].to_numpy(), table["extra"].to_numpy()
        words = Words(table["chunk"].chunk(0))
        ids, chunk = words.ids, words.row
        at = np.flatnonzero(np.arange(len(words)) + np.maximum(length, extra[chunk] + 1) <= words.end)
        if filter_ is not None:
            known = _known(words, langs, length - 1, filter_)
            at = at[known[at] & known[at + 1]]
        code = of_chunk[chunk[at]].astype(np.int64)
        for k in range(length):
            code = code * np.int64(len(words.distinct) + 1) + ids[at + k]
            if 0 < k < length - 1:  # keep the numbers small
                code = np.unique(code, return_inverse=True)[1]
        order = np.argsort(code)
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        weights = np.add.reduceat(uses[chunk[at]][order], first) if len(first) else np.zeros(0, np.int64)
        at = at[order[first]]
        return pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(of_chunk[chunk[at]])), words.joined(at, at + length), pa.array(weights)], ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = BitFilter(*shared.value) if shared else None
        for table in _by_size(batches):
            yield counted(table, filter_)

    return chunks.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _dealt(keyed: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """``keyed`` with the count of its phrase ``key``; counts stand once in every lane, so popular phrases are dealt out."""
    every = counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name), F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("_lane"))
    return keyed.withColumn("_lane", F.pmod(F.xxhash64("phrase"), F.lit(LANES)).cast("int")).join(every, ["lang", key, "_lane"]).drop("_lane", key)


def _rest(phrase: Column, first: Column) -> Column:
    return F.substring(phrase, F.char_length(first) + 2, F.char_length(phrase))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to five words of each language."""
    chunks = durable(dictionary(docs, lang, text))
    every = durable(count_phrases(chunks, 1, None))
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    by_length = [durable(every.where(F.col("f") >= least))]
    for length in range(2, WORDS + 1):
        parts = frequent_filter(by_length[-1])
        if length == 3:  # few chunks hold longer phrases; those to come read these alone
            chunks = durable(chunks_with_neighbours(chunks, parts, length - 1))
        by_length.append(durable(count_phrases(chunks, length, parts).where(F.col("f") >= least)))
    counts = reduce(DataFrame.unionByName, by_length)
    phrases = reduce(DataFrame.unionByName, [df.withColumn("m", F.lit(i + 2)) for i, df in enumerate(by_length[1:])]).withColumnRenamed("f", "a")

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumn("first", F.call_function("substring_index", "phrase", F.lit(" "), F.col("k")))
    cuts = _dealt(_dealt(cuts.withColumn("rest", _rest(F.col("phrase"), F.col("first"))), counts, "first", "l"), counts, "rest", "r")
    score = exact_quotient(whole(1000) * whole(F.col("a")) * whole(F.col("n")), whole(F.col("l")) * whole(F.col("r")))
    cuts = cuts.join(sized(totals), "lang").withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    longer = phrases.where("m > 2")
    head = F.call_function("substring_index", "phrase", F.lit(" "), F.col("m") - 1)
    tail = _rest(F.col("phrase"), F.call_function("substring_index", "phrase", F.lit(" "), F.lit(1)))
    inside = longer.select("lang", F.explode(F.array(head, tail)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    # A longer phrase is no more frequent than what it holds, so one word more is enough to look at.
    kept = best.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a")
    kept = kept.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(LANES)).alias("_lane"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    kept = kept.withColumn("_place", F.row_number().over(W.partitionBy("lang", "_lane").orderBy(*order))).where(F.col("_place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
