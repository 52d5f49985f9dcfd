"""Near-duplicate classes by banded MinHash and sequential Bayesian verification.

1. Documents of equal shingle sets are one class; the rest works on classes.
2. Bands of a MinHash signature put classes in buckets.  Rows and number of bands follow from the
   threshold, the number of classes and the chosen miss probability.
3. Buckets chain to clusters, the only places where links can be.  Texts are fetched for clusters
   alone, once.  A small cluster shares a task with others; a large one is cut in blocks, and each
   pair of blocks is a task of its own, so none holds a cluster.
4. In a task, pairs that share a band are compared by batches of signature rows.  With a uniform
   prior, m matches of k leave a Beta posterior; a pair goes as soon as the posterior probability
   of the threshold is below ``MISS``.
5. Survivors are verified on full sets, likely ones first; a pair whose ends verified links have
   already joined needs no test.  A task returns the links that join, fewer than it has classes.

The class of a document is the smallest doc_id that links reach.  Null and empty texts, and those
of white space, have no shingles and are linked with nothing.  Rows without an id take no part and
stay.  Repeated rows share a class; a repeated id is kept with each of its rows that is its
class's smallest.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamwatch.llm.common import byte_views, components, durable, mix, packed, shingle_hashes, slices, word_hashes

THRESHOLD = (80, 100)
#: The probability at which the bands, and again the Bayesian test, may miss a link.
MISS = 1e-9
BATCH = 20
#: Classes, and bytes of text, of a block.
BLOCK_ROWS, BLOCK_BYTES = 1024, 6 << 20
#: Members beyond which they are not broadcast to fetch texts.
BROADCAST_ROWS = 1_000_000


def bands_for(classes: int, miss: float = 1e-7, threshold: tuple[int, int] = THRESHOLD) -> tuple[int, int]:
    """(bands, rows): a row more for 16 times as many classes keeps chance collisions at bay."""
    rows = 5 + max(0, math.ceil(math.log(max(classes, 1) / 1e6, 16)))
    return math.ceil(math.log(miss) / math.log(1 - (threshold[0] / threshold[1]) ** rows)), rows


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def sets_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, end to end and sorted, and their number in each."""
    hashes, sizes = shingle_hashes(*word_hashes(*byte_views(texts)), width)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(sizes))


def signatures(hashes: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """MinHash values, one row for each set that is not empty."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), length), np.uint32)
    if not len(starts):
        return out
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    work = np.empty_like(short)
    for i, (a, b) in enumerate(zip(*_coefficients(length), strict=True)):
        np.multiply(short, a, out=work)
        np.add(work, b, out=work)
        out[:, i] = np.minimum.reduceat(work, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    cut = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r] + np.uint64(r + 1))
    return keys + np.arange(bands, dtype=np.uint64)


def set_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each set that is not empty."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    both = [mix(np.add.reduceat(mix(hashes + np.uint64(s)), starts) + sizes[sizes > 0].astype(np.uint64)) for s in (0, 0x51ED270B)]
    return np.stack(both, axis=1).view(np.int64)


def _describe(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                hashes, sizes = sets_of(texts, width)
                there = sizes > 0
                keys = np.zeros((len(sizes), 2), np.int64)
                keys[there] = set_keys(hashes, sizes)
                found = band_keys(signatures(hashes, sizes, bands * rows), bands, rows).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(there, bands, 0))]).astype(np.int32)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(at, len(texts)), "tag": batch.column("tag").slice(at, len(texts)), "n": sizes.astype(np.int64), "k1": keys[:, 0], "k2": keys[:, 1],
                    "keys": pa.ListArray.from_arrays(ends, found.reshape(-1))})

    return run


def least_matches(k: int, miss: float = MISS, threshold: tuple[int, int] = THRESHOLD) -> int:
    """The fewest matches of ``k`` with which the posterior probability of the threshold reaches ``miss``."""
    t, tail = threshold[0] / threshold[1], 0.0
    for m in range(k + 1):
        tail += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        if tail >= miss:
            return m
    return k


class Forest:
    """Union-find over a task's classes."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == max(x, y)] = min(x, y)
            self.links.append((a, b))


def _shared(a: np.ndarray, b: np.ndarray, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a[i] and b[i]."""
    n = len(ends) - 1
    if len(a) <= 4 * n:
        return np.array([len(np.intersect1d(hashes[ends[x] : ends[x + 1]], hashes[ends[y] : ends[y + 1]], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    values, place, uses = np.unique(hashes, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), np.diff(ends))
    column = np.cumsum(uses > 1) - 1
    common = uses[place] > 1  # a shingle of one set alone is in no intersection
    owner, place = owner[common], column[place[common]]
    total = np.zeros((n, n), np.float32)
    for at in range(0, int((uses > 1).sum()), 4096):
        part = (place >= at) & (place < at + 4096)
        dense = np.zeros((n, 4096), np.float32)
        dense[owner[part], place[part] - at] = 1
        total += dense @ dense.T
    return np.rint(total[a, b]).astype(np.int64)


def linked(texts: pa.Array, width: int, bands: int, rows: int, sides: np.ndarray | None = None,
           threshold: tuple[int, int] = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join all texts whose pairs meet the threshold; ``sides`` restricts pairs to unlike ones."""
    found = [sets_of(part, width) for _, part in slices(texts)]
    hashes, sizes = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    signature = np.concatenate([signatures(h, s, bands * rows) for h, s in found])
    keys = band_keys(signature, bands, rows)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    pairs = _candidates(keys, n, sides)
    a, b = pairs // n, pairs % n
    ratio = threshold[0] / threshold[1]
    fits = np.minimum(sizes[a], sizes[b]) >= ratio * np.maximum(sizes[a], sizes[b]) - 1e-9
    a, b = a[fits], b[fits]
    matches = np.zeros(len(a), np.int64)
    for at in range(0, signature.shape[1], BATCH):
        to = min(at + BATCH, signature.shape[1])
        for i in range(at, to):
            column = signature[:, i]
            matches += column[a] == column[b]
        alive = matches >= least_matches(to, threshold=threshold)
        a, b, matches = a[alive], b[alive], matches[alive]
    forest = Forest(n)
    order = np.argsort(-matches, kind="stable")
    a, b = a[order], b[order]
    step = max(64, n)
    while len(a):
        x, y = a[:step], b[:step]
        shared = _shared(x, y, hashes, ends)
        good = threshold[1] * shared >= threshold[0] * (sizes[x] + sizes[y] - shared)
        for p, q in zip(x[good], y[good], strict=True):
            forest.join(int(p), int(q))
        a, b = a[step:], b[step:]
        apart = forest.label[a] != forest.label[b]
        a, b = a[apart], b[apart]
        step *= 8
    return forest.links


def _candidates(keys: np.ndarray, n: int, sides: np.ndarray | None) -> np.ndarray:
    """Pairs that share a band, as a * n + b with a < b, each once."""
    met = np.zeros((n, n), bool)
    for column in keys.T:
        order = np.argsort(column, kind="stable")
        cuts = np.flatnonzero(np.diff(column[order])) + 1
        for run in np.split(order, cuts):
            if len(run) > 1:
                met[np.ix_(run, run)] = True
    met &= np.triu(np.ones((n, n), bool), 1)
    if sides is not None:
        met &= sides[:, None] != sides[None, :]
    return np.flatnonzero(met)


def _verify(width: int, bands: int, rows: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("node", "ascending")])
        texts, nodes = group["text"].combine_chunks(), np.asarray(group["node"].combine_chunks())
        want = np.stack([np.asarray(group["k1"].combine_chunks()), np.asarray(group["k2"].combine_chunks())], axis=1)
        own = np.zeros((len(nodes), 2), np.int64)
        for at, part in slices(texts):
            hashes, sizes = sets_of(part, width)
            own[at + np.flatnonzero(sizes)] = set_keys(hashes, sizes)
        keep = (own == want).all(axis=1)  # of an id with several texts, the class's
        held = np.flatnonzero(keep)
        keep[held[1:]] = nodes[held[1:]] != nodes[held[:-1]]  # the first of a node's right rows
        texts, nodes = texts.filter(pa.array(keep)), nodes[keep]
        sides = np.asarray(group["side"].combine_chunks())[keep]
        links = linked(texts, width, bands, rows, sides if len(set(sides)) > 1 else None) if len(nodes) > 1 else []
        return pa.table({"a": nodes[[x for x, _ in links]].astype(np.int64), "b": nodes[[y for _, y in links]].astype(np.int64)})

    return run


def near_duplicates(docs: DataFrame, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, kept), one row for each document; ``tag`` is the text's hash."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    bands, rows = bands_for(own.count())
    described = durable(own.mapInArrow(_describe(width, bands, rows), "doc_id long, tag long, n long, k1 long, k2 long, keys array<long>"))
    real = described.where("n > 0 and doc_id is not null")
    classes = durable(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.min("n").alias("n"), F.min_by("keys", "doc_id").alias("keys")))
    spread = classes.select(F.posexplode("keys").alias("band", "key"), F.col("k1").alias("node"), "n")
    buckets = spread.groupBy("band", "key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = spread.join(buckets, ["band", "key"]).where(F.col("node") != F.col("lead.node"))
    small = F.least(F.col("n"), F.col("lead.n")) * THRESHOLD[1] >= F.greatest(F.col("n"), F.col("lead.n")) * THRESHOLD[0]
    clusters = durable(components(met.where((F.col("members") > 2) | small).select(F.col("node").alias("a"), F.col("lead.node").alias("b"))))
    links = durable(_links(own, classes, clusters, width, bands, rows))
    reach = components(links)
    ids = classes.select(F.col("k1").alias("node"), "k2", "cid").join(reach, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("cid").alias("component_id"))
    named = ids.join(least, "root").select(F.col("node").alias("k1"), "k2", "component_id")
    joined = described.drop("keys").join(named, ["k1", "k2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "tag", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(own: DataFrame, classes: DataFrame, clusters: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Verified links (a, b) between classes of one cluster."""
    members = classes.select(F.col("cid").alias("doc_id"), "k1", "k2").join(clusters.withColumnRenamed("node", "k1"), "k1").select("doc_id", F.col("k1").alias("node"), "k2", "root")
    count = members.count()
    near = F.broadcast(members) if count <= BROADCAST_ROWS else members
    fetched = durable(own.drop("tag").join(near, "doc_id").dropDuplicates(["node", "doc_id", "text"]))
    weight = fetched.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("text")).alias("size"))
    cut = weight.select("root", F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    totals = weight.agg(F.sum("m").alias("m"), F.sum("size").alias("size")).first()
    bins = max(1, math.ceil((totals["m"] or 0) / (BLOCK_ROWS // 2)), math.ceil((totals["size"] or 0) / BLOCK_BYTES))
    rows_ = fetched.join(cut, "root").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    alone = rows_.where("blocks = 1").select(F.lit(0).alias("many"), F.pmod(F.xxhash64("root"), F.lit(bins)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), "*")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = rows_.where("blocks > 1").select("*", other.alias("o")).select(
        F.lit(1).alias("many"), F.col("root").alias("g"), F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), *rows_.columns)
    wanted = ["many", "g", "i", "j", "node", F.col("node").alias("k1"), "k2", "side", "text"]
    tasks = alone.select(wanted).unionByName(met.select(wanted))
    return tasks.groupBy("many", "g", "i", "j").applyInArrow(_verify(width, bands, rows), "a long, b long")


def drop_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each class, with all its columns; rows alike in id and text are one document."""
    judged = durable(near_duplicates(docs, width))
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("tag").alias("_tag"))
    near = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = packed(docs, _id=docs["doc_id"], _text_tag=F.xxhash64(docs["text"]))

    def same(df: DataFrame) -> Column:
        return (df["_id"] == F.col("_gone")) & (df["_text_tag"] == F.col("_tag"))

    staying = rows.join(near, same(rows), "left_anti")
    again = judged.where("doc_id is not null").groupBy("doc_id", "tag").count().where("count > 1")
    if again.isEmpty():
        return staying.select("_row.*")
    again = durable(again).select(F.col("doc_id").alias("_gone"), F.col("tag").alias("_tag"))
    once = staying.join(again, same(staying), "left_semi").dropDuplicates(["_id", "_text_tag"])
    return staying.join(again, same(staying), "left_anti").unionByName(once).select("_row.*")
