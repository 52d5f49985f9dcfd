"""Source divergence audit with bitmaps by count level.

Within a language every source gives each kept term a smoothed share p of its occurrences, as an
integer in billionths.  Two sources are as far apart as the sum of |p - p'| over the kept terms.
Terms of one source with the same count have the same p, so a source is stored as *levels*: for each
count that occurs, the set of its terms as bits.  For two sources the AND of two levels and its
popcount give the number of terms in that joint cell, which is multiplied by the cell's |p - p'|;
cells in which one or both counts are zero follow from the complement, without being stored.

Term numbers are local to a block: terms of about equal frequency, dealt into lanes of about
``BLOCK_TERMS``, so a block's levels are few and no task holds a vocabulary.  A task takes one block
for ``GROUP_BLOCK`` sources against as many others, and the blocks' sums are added.  All sums are
integers; p is computed from 38-digit decimals.

Null texts, languages and sources are read as empty strings.  Rows of one id count apart.  Sources
without terms have p by smoothing alone; a language without kept terms has distance 0 for all its
pairs.  Equal values rank by the item's UTF-8 bytes.  Very long texts are read whole.  Other columns
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamwatch.llm.common import durable, exact_quotient, sized, whole

MIN_DOCUMENTS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
BLOCK_TERMS = 2048
#: Sources that meet as many others in one task.
GROUP_BLOCK = 128
#: Distinct (group, term) entries that a task holds before it passes them on.
HELD_TERMS = 400_000
#: Rows of levels that are compared at once.
SLICE = 512
#: A-Z as a-z, other ASCII letters and all bytes of other characters as they are, the rest white.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly."""
    above = whole(SCALE) * (whole(count) + whole(SMOOTHING))
    below = whole(total) + whole(terms) * whole(SMOOTHING)
    return exact_quotient(above, below) + F.lit(1).cast("long")


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        seen = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang_, source_), (n, holders) in counts.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang_] * len(terms)), pa.array([source_] * len(terms)), pa.array([t.decode() for t in terms], pa.string()),
                     pa.array(list(n.values()), pa.int64()), pa.array([holders[t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "n", "docs"])
            counts.clear()

        for batch in batches:
            for lang_, source_, value in zip(*(batch.column(i) for i in range(3)), strict=True):
                terms = (value.as_py() or "").encode().translate(_TERM_BYTES).split()
                if terms:
                    held = counts.setdefault((lang_.as_py(), source_.as_py()), (Counter(), Counter()))
                    before = len(held[0])
                    held[0].update(terms)
                    held[1].update(set(terms))
                    seen += len(held[0]) - before
                    if seen >= HELD_TERMS:
                        yield from rows()
                        seen = 0
        yield from rows()

    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = own.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def number_terms(counts: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, total, block, lane, place) of the terms in at least ``least`` documents of the language.

    ``block`` is the frequency's power of two, ``lane`` a part of about ``BLOCK_TERMS`` of its terms,
    ``place`` counts from 0 in it, frequent terms first.
    """
    kept = durable(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
                   .select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("block")))
    lanes = kept.groupBy("lang", "block").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TERMS)).alias("lanes"))
    rows = kept.join(sized(lanes), ["lang", "block"]).withColumn("lane", F.pmod(F.xxhash64("term"), "lanes").cast("int"))
    order = W.partitionBy("lang", "block", "lane").orderBy(F.desc("total"), "term")
    return rows.withColumn("place", F.row_number().over(order) - 1).drop("lanes")


def levels(cells: DataFrame) -> DataFrame:
    """(lang, block, lane, source, n, word, bits): the terms with count n in the source, 64 to a word."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    return cells.groupBy("lang", "block", "lane", "source", "n", (F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def _cell_sums(table: pa.Table, groups: pa.Table) -> pa.Table:
    """Distances of all pairs of two group blocks over one block of terms."""
    low, high = groups["low"][0].as_py(), groups["high"][0].as_py()
    names, own = groups["source"].to_pylist(), groups["own"].to_numpy()
    zero, terms = groups["zero"].to_numpy(), groups["terms"][0].as_py()
    at = {name: i for i, name in enumerate(names)}
    order = sorted(range(len(names)), key=lambda i: names[i])
    left = [i for i in order if own[i] == low]
    right = [i for i in order if own[i] == high]
    holder = np.fromiter((at[s] for s in table["source"].to_pylist()), np.int64, table.num_rows)
    word, p = table["word"].to_numpy(), table["p"].to_numpy()
    bits = table["bits"].to_numpy().view(np.uint64)
    row, column = np.full(len(names), -1), np.full(len(names), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    total = np.zeros((len(left), len(right)), np.int64)
    shared = np.zeros_like(total)
    zero_left, zero_right = zero[left], zero[right]
    sort = np.lexsort((holder, word))
    starts = np.flatnonzero(np.diff(word[sort], prepend=-1))
    sizes_left, sizes_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    size = np.bitwise_count(bits).astype(np.int64)
    np.add.at(sizes_left, row[holder][row[holder] >= 0], size[row[holder] >= 0])
    np.add.at(sizes_right, column[holder][column[holder] >= 0], size[column[holder] >= 0])
    # A level's terms against count 0 on the other side: all of them here, those of joint cells are taken back below.
    for place, zeros, out in ((row, zero_right, total), (column, zero_left, total.T)):
        own_rows = np.flatnonzero(place[holder] >= 0)
        own_rows = own_rows[np.argsort(place[holder[own_rows]], kind="stable")]
        for at_ in range(0, len(own_rows), SLICE):
            part = own_rows[at_ : at_ + SLICE]
            group = place[holder[part]]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            out[group[first]] += np.add.reduceat(size[part][:, None] * np.abs(p[part][:, None] - zeros[None, :]), first, 0)
    for k, start in enumerate(starts):
        rows = sort[start : starts[k + 1] if k + 1 < len(starts) else len(sort)]
        a, b = rows[row[holder[rows]] >= 0], rows[column[holder[rows]] >= 0]
        if not len(a) or not len(b):
            continue
        a, b = a[np.argsort(row[holder[a]], kind="stable")], b[np.argsort(column[holder[b]], kind="stable")]
        b_group = column[holder[b]]
        b_first = np.flatnonzero(np.diff(b_group, prepend=-1))
        for at_ in range(0, len(a), SLICE):
            part = a[at_ : at_ + SLICE]
            a_group = row[holder[part]]
            a_first = np.flatnonzero(np.diff(a_group, prepend=-1))
            joint = np.bitwise_count(bits[part][:, None] & bits[b][None, :]).astype(np.int64)
            gain = np.abs(p[part][:, None] - p[b][None, :])
            gain -= np.abs(p[part][:, None] - zero_right[b_group][None, :])
            gain -= np.abs(zero_left[a_group][:, None] - p[b][None, :])
            gain *= joint
            cell = np.ix_(a_group[a_first], b_group[b_first])
            total[cell] += np.add.reduceat(np.add.reduceat(gain, a_first, 0), b_first, 1)
            shared[cell] += np.add.reduceat(np.add.reduceat(joint, a_first, 0), b_first, 1)
    neither = terms - sizes_left[:, None] - sizes_right[None, :] + shared
    total += neither * np.abs(zero_left[:, None] - zero_right[None, :])
    keep = np.triu(np.ones(total.shape, bool), 1) if low == high else np.ones(total.shape, bool)
    i, j = np.nonzero(keep)
    return pa.table({
        "lang": pa.array([groups["lang"][0].as_py()] * len(i), pa.string()), "source": pa.array([names[left[x]] for x in i], pa.string()),
        "other": pa.array([names[right[x]] for x in j], pa.string()), "value": pa.array(total[i, j], pa.int64())})


def _meetings(df: DataFrame) -> DataFrame:
    """Each row for every pair (low, high) of group blocks that its own block is in."""
    other = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).drop("other", "blocks")


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources and the terms above the language's share."""
    counts = durable(term_counts(docs, lang, source, text))
    kept = durable(number_terms(counts, least))
    cells = durable(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total", "block", "lane", "place"))
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    of_lang = named.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_BLOCK)).cast("int").alias("blocks")).join(
        kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total")), "lang", "left")
    groups = named.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("group_total")), ["lang", "source"], "left").join(of_lang, "lang")
    groups = durable(groups.na.fill(0, ["group_total", "terms", "lang_total"]).withColumns({
        "own": F.pmod(F.xxhash64("source"), "blocks").cast("int"),
        "zero": F.when(F.col("terms") > 0, share(F.lit(0), F.col("group_total"), F.col("terms"))).otherwise(F.lit(0).cast("long"))}))
    shares = sized(groups.select(*[F.col(c).alias(c) for c in ("lang", "source", "group_total", "terms", "lang_total", "own", "blocks")]))

    p = share(F.col("n"), F.col("group_total"), F.col("terms"))
    bitmaps = _meetings(levels(cells).join(shares, ["lang", "source"]).select(
        "lang", "block", "lane", "source", "word", "bits", p.alias("p"), "own", "blocks"))
    term_blocks = kept.groupBy("lang", "block", "lane").agg(F.count(F.lit(1)).alias("size"))
    meeting = _meetings(groups.select("lang", "source", "own", "blocks", "zero").join(sized(term_blocks), "lang", "left").select(
        "lang", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("lane", F.lit(0)).alias("lane"), "source", "own", "blocks", "zero",
        F.coalesce("size", F.lit(0)).cast("long").alias("terms")))
    by = ["lang", "block", "lane", "low", "high"]
    sums = bitmaps.groupBy(*by).cogroup(meeting.groupBy(*by)).applyInArrow(_cell_sums, "lang string, source string, other string, value long")
    sums = sums.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(
        F.struct(F.col("source").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("p"), "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value").withColumn("rank", F.row_number().over(order))

    q = share(F.col("total"), F.col("lang_total"), F.col("terms"))
    above = cells.join(shares, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
    terms = above.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
