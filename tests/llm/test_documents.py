"""Operators on documents against brute force on small awkward inputs."""

import hashlib
import os
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seamwatch.llm import decontaminate, langid, licenses, lines, mixing, neardup, pii, sharding, suffix
from tests.llm.fixtures import documents, empty, prose, rows

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- sharding

def test_sharding_law_positions_and_sizes(docs):
    sized = docs.select("doc_id", sharding.record_bytes().alias("size"))
    slot_map = sharding.plan_map(sharding.slot_bytes(docs), 4)
    got = sharding.number(sharding.assign(sized, slot_map), ["doc_id", "size"]).collect()
    assert len(got) == docs.count()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16) for r in rows())
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_is_even_and_rebalances_by_slots(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = sharding.slot_bytes(many)
    first = sharding.plan_map(sizes, 8)
    loads = [r[0] for r in first.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(loads) == 8 and max(loads) < 1.01 * min(loads)
    second = sharding.rebalance(first, sizes, 9)
    both = first.withColumnRenamed("shard", "was").join(second.select("virtual_slot", "shard", F.col("version").alias("v")), "virtual_slot")
    assert both.count() == sharding.SLOTS and {r[0] for r in both.select("v").distinct().collect()} == {2}
    moved = both.where("was <> shard").join(sizes, "virtual_slot").agg(F.sum("bytes")).first()[0]
    assert moved < 1.2 * sum(loads) / 9
    grown = [r[0] for r in second.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(grown) == 9 and max(grown) < 1.05 * min(grown)


def test_sharding_stays_even_with_null_and_repeated_keys(spark, tmp_path):
    many = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2000).alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("base"), "id")
    many = many.select("doc_id", F.concat("base", F.col("id").cast("string")).alias("text"), F.lit("mine").alias("_lane"), F.lit(7).alias("rank"))
    out = sharding.shard_documents(many, 8, maps=str(tmp_path / "maps"))
    loads = [r["n"] for r in out.groupBy("shard").agg(F.sum(sharding.record_bytes()).alias("n")).collect()]
    assert len(loads) == 8 and max(loads) < 1.01 * min(loads)
    numbered = sharding.number(out, ["doc_id", "text"], ["doc_id", "text"])
    assert numbered.columns == [*out.columns, "slot"] and {r["_lane"] for r in numbered.select("_lane").distinct().collect()} == {"mine"}
    by = defaultdict(list)
    for r in numbered.collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    later = sharding.shard_documents(many, 9, maps=str(tmp_path / "maps"))
    assert {r[0] for r in later.select("map_version").distinct().collect()} == {2} and {r[0] for r in later.select("shard").distinct().collect()} == set(range(9))
    moved = out.select("doc_id", "text", "shard").join(later.select("doc_id", "text", F.col("shard").alias("now")), (out["doc_id"].eqNullSafe(later["doc_id"])) & (out["text"] == later["text"]))
    assert moved.where("shard <> now").count() < 0.2 * 6000


def test_stages_keep_columns_of_clashing_names(spark, docs):
    extra = {n: F.lit("mine") for n in ("_tag", "_gone", "_id", "_text_tag", "_row", "_u", "_topic", "rank", "lane", "node", "root", "item")}
    table = docs.withColumns(extra)
    items = spark.createDataFrame([(1, prose(0, 60))], "item_id long, text string")
    for out in (neardup.drop_near_duplicates(table), decontaminate.decontaminate(table, items), mixing.sample(table), sharding.shard_documents(table, 3).drop("virtual_slot", "shard", "map_version")):
        assert out.columns == table.columns and {r["_tag"] for r in out.select("_tag").collect()} == {"mine"}


def test_sharding_versions_are_kept(spark, docs, tmp_path):
    sizes = sharding.slot_bytes(docs)
    first = sharding.plan_map(sizes, 3)
    sharding.save_map(first, f"{tmp_path}/maps")
    sharding.save_map(sharding.rebalance(first, sizes, 4), f"{tmp_path}/maps")
    assert sharding.load_map(spark, f"{tmp_path}/maps").select("version").first()[0] == 2
    assert plain(sharding.load_map(spark, f"{tmp_path}/maps", 1), "virtual_slot", "shard") == plain(first, "virtual_slot", "shard")


def test_sharding_clashing_columns_and_empty(spark, docs):
    clash = docs.withColumn("shard", F.lit("mine")).withColumn("_row", F.lit(1))
    out = sharding.shard_documents(clash, 3)
    assert out.columns.count("shard") == 1 and dict(out.dtypes)["shard"] == "int" and out.count() == docs.count()
    assert sharding.shard_documents(empty(spark), 3).count() == 0


# --- language

def test_language(spark, docs):
    clash = docs.withColumn("score", F.lit("mine"))
    dictionaries = langid.fit(clash)
    got = {r["doc_id"]: r for r in langid.identify(clash, dictionaries).collect() if r["doc_id"] is not None}
    right = [got[r[0]]["lang_pred"] == r[2] for r in rows() if r[0] is not None and r[0] < 40]
    assert sum(right) >= 38
    for i in (60, 61, 62, 64):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["lang_rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", langid.held_out().alias("h")).collect() if r["doc_id"] is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def test_language_empty_and_unlabelled(spark, docs):
    assert langid.fit(empty(spark)) == {}
    assert langid.identify(empty(spark), {}).count() == 0
    assert {r[0] for r in langid.identify(docs, {}).select("lang_pred").collect()} == {"und"}
    assert {r[0] for r in langid.identify(docs, {"en": b"the of and"}).where("doc_id < 40").select("lang_pred").collect()} == {"en"}


# --- near duplicates

def sets_of(text, width):
    found = re.findall(rf"[^{re.escape(SPACE)}]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def brute_classes(data, width):
    sets = [(i, sets_of(t, width)) for i, t in data]
    root = {}
    for i, _ in sets:
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i) if i is not None else None) for i, s in sets]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    want = brute_classes([(r[0], r[1]) for r in rows()], width)
    got = neardup.near_duplicates(docs, width)
    assert plain(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=str)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_duplicates_large_group_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(1, 120).split()
    data = []
    for i in range(150):
        own = [w if rng.random() > rng.choice([0.0, 0.02, 0.05, 0.09]) else f"w{rng.randrange(10**6)}" for w in base]
        data.append((1000 - i, " ".join(own)))
    data += [(i, prose(900 + i, 100)) for i in range(40)]
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 32)
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 2)
    assert plain(got, "doc_id", "n_shingles", "component_id") == sorted(brute_classes(data, 2), key=str)


def test_bayesian_bounds():
    assert neardup.least_matches(20) < 16 and neardup.least_matches(200) < 160
    assert all(neardup.least_matches(k) <= neardup.least_matches(k + 1) for k in range(1, 100))
    assert neardup.bands_for(10**6)[1] == 5 and neardup.bands_for(10**9)[1] > 5


def test_near_duplicates_empty_and_one_of_each(spark, docs):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.drop_near_duplicates(docs.withColumn("tag", F.lit("x")), 5)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[50] == 1 and 51 not in ids and 52 not in ids and 53 not in ids and ids[70] == 1 and ids[None] == 2
    assert kept.columns == [*docs.columns, "tag"]


@pytest.mark.parametrize("wrong_first", [True, False])
def test_near_duplicates_of_an_id_with_two_texts(wrong_first):
    base = prose(100, 80)
    near, wrong = f"{base} changed", prose(101, 80)
    keys = lambda text: neardup.set_keys(*neardup.sets_of(pa.array([text]), 2))[0]
    (a1, a2), (b1, b2) = keys(base), keys(near)
    one = [(a1, a2, wrong), (a1, a2, base)] if wrong_first else [(a1, a2, base), (a1, a2, wrong)]
    group = [*one, (a1, a2, base), (b1, b2, near)]
    table = pa.table({"node": pa.array([g[0] for g in group], pa.int64()), "k1": pa.array([g[0] for g in group], pa.int64()), "k2": pa.array([g[1] for g in group], pa.int64()),
                      "side": pa.array([0] * len(group), pa.int32()), "text": [g[2] for g in group]})
    got = neardup._verify(2, *neardup.bands_for(10))(table).to_pylist()
    assert [{r["a"], r["b"]} for r in got] == [{int(a1), int(b1)}]


def test_near_duplicates_of_ids_with_two_texts(spark):
    base = prose(100, 80)
    for order in (1, -1):
        data = [(1, base), (1, prose(101, 80)), (2, f"{base} changed"), (2, prose(102, 80))][::order]
        got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), 2)
        assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (1, 1), (2, 1), (2, 2)]


# --- benchmark

def test_decontamination(spark, docs):
    item = prose(5, 60)
    items = spark.createDataFrame([(1, " ".join(item.split()[10:40])), (2, prose(999, 30)), (3, None), (4, ""), (5, prose(999, 30)), (6, "under green")], "item_id long, text string")
    docs = docs.unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    got = decontaminate.search(docs, items)
    want = {(None, 1, 26, 26)}
    for i, t, *_ in rows():
        for j, s in ((1, " ".join(item.split()[10:40])), (2, prose(999, 30)), (6, "under green")):
            width = min(5, len(s.split()))
            q, x = sets_of(s, width), sets_of(t, width) if len((t or "").split()) >= width else frozenset()
            if t and 10 * len(q & x) >= 8 * len(q):
                want.add((i, j, len(q & x), len(q)))
    assert {(r["doc"], r["item"], r["n_shared"], r["n_item"]) for r in got.collect()} == want and any(w[1] == 1 for w in want)
    clean = decontaminate.decontaminate(docs, items)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in rows() if r[0] is None or r[0] not in {w[0] for w in want})
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(rows()) + 1
    assert decontaminate.search(empty(spark), items).count() == 0


def test_decontamination_names_every_id_of_a_repeated_item(spark):
    base = prose(5, 40)
    items = spark.createDataFrame([(7, base), (42, base), (43, base.upper().replace(" ", "\n")), (42, base), (9, prose(6, 40))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{prose(1, 30)} {base}"), (2, prose(2, 60))], "doc_id long, text string")
    got = decontaminate.search(docs, items).collect()
    assert sorted((r["doc"], r["item"], r["n_shared"], r["n_item"]) for r in got) == [(1, i, 36, 36) for i in (7, 42, 43)]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [2]


# --- mixing

def test_mixing(spark, docs):
    got = mixing.mix(docs.withColumn("weight", F.lit("mine"))).collect()
    assert len(got) == docs.count() and all(0 <= r["probability"] <= 1 for r in got)
    assert {r["tokens"] for r in got if not r["text"]} == {0}
    whole = sum(r["tokens"] for r in got)
    assert abs(sum(r["tokens"] * r["probability"] for r in got) / whole - mixing.KEEP) < 0.05
    again = mixing.mix(docs).where("taken").count()
    assert again == sum(r["taken"] for r in got) == mixing.sample(docs).count()
    assert mixing.mix(empty(spark)).count() == 0


def raked_by_hand(tokens, goals, keep, sweeps=4000):
    """Probabilities of a dense table by plain raking in numpy, with the cut at 1."""
    total = tokens.sum() * keep
    factors = [np.ones(n) for n in tokens.shape]
    factors[0] *= keep
    for _ in range(sweeps):
        for d in range(3):
            p = np.minimum(np.einsum("i,j,k->ijk", *factors), 1)
            expected = (tokens * p).sum(axis=tuple(x for x in range(3) if x != d))
            factors[d] *= np.where(expected > 0, np.asarray(goals[d]) * total / np.where(expected > 0, expected, 1), 1)
    return np.minimum(np.einsum("i,j,k->ijk", *factors), 1)


@pytest.mark.parametrize("arrays", [True, False])
def test_raking_equals_brute_force(spark, monkeypatch, arrays):
    monkeypatch.setattr(mixing, "ARRAY_CELLS", 5000 if arrays else 3)
    rng = np.random.default_rng(8)
    tokens = rng.integers(0, 900, (4, 3, 3)) * (rng.random((4, 3, 3)) < 0.8)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(tokens[i, j, k])) for i, j, k in np.ndindex(tokens.shape)], "source string, lang string, topic string, tokens long")
    wanted = {d: mixing.targets(cells, d, 0.6, 0.5) for d in mixing.DIMENSIONS}
    shares = {d: {r[0]: r["target"] for r in w.collect()} for d, w in wanted.items()}
    assert all(abs(sum(s.values()) - 1) < 1e-9 for s in shares.values())
    for d, axis in zip(mixing.DIMENSIONS, range(3), strict=True):
        have = tokens.sum(axis=tuple(x for x in range(3) if x != axis)) / tokens.sum()
        assert all(t <= have[int(v[1:])] / 0.5 + 1e-12 for v, t in shares[d].items())
    goals = [[shares[d].get(f"{d[0]}{i}", 0.0) for i in range(n)] for d, n in zip(mixing.DIMENSIONS, tokens.shape, strict=True)]
    fitted = mixing.fit(cells, wanted, 0.5, tolerance=1e-7 if arrays else 1e-3)
    want = raked_by_hand(tokens, goals, 0.5)
    for r in fitted.collect():
        at = int(r["source"][1:]), int(r["lang"][1:]), int(r["topic"][1:])
        assert abs(r["probability"] - want[at]) < (1e-3 if arrays else 0.02), (at, r["probability"], want[at])
    errors = mixing.marginals(fitted, wanted, 0.5).collect()
    assert len(errors) == sum(map(len, shares.values())) and max(abs(r["error"]) for r in errors) < (1e-5 if arrays else 1e-2)


def test_raking_that_cannot_meet_its_marginals_ends_and_says_so(spark):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("b", "y", "p", 900)], "source string, lang string, topic string, tokens long")
    wanted = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, target double"),
              "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "lang string, target double"), "topic": spark.createDataFrame([("p", 1.0)], "topic string, target double")}
    fitted = mixing.fit(cells, wanted, keep=0.5)
    assert fitted.count() == 2 and max(abs(r["error"]) for r in mixing.marginals(fitted, wanted, 0.5).collect()) > 0.1


def test_tokens_are_counted_as_words(spark):
    texts = ["", " ", "a", " a b ", "a\tb\nc\x0bd\x0ce\rf", "  é  語語 x", "a\u00a0b", None, "\n\n", "x" * 70_000 + " y"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.token_count().alias("n")).collect()
    assert [r["n"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_raking_meets_marginals(spark):
    cells = spark.createDataFrame([(s, la, t, 100 + 37 * i) for i, (s, la, t) in enumerate((s, la, t) for s in "abc" for la in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    wanted = {"source": spark.createDataFrame([("a", 0.4), ("b", 0.3), ("c", 0.3)], "source string, target double"),
              "lang": spark.createDataFrame([("x", 0.55), ("y", 0.45)], "lang string, target double"),
              "topic": spark.createDataFrame([("p", 0.5), ("q", 0.5)], "topic string, target double")}
    out = mixing.fit(cells, wanted, keep=0.4, sweeps=20).collect()
    total = sum(r["tokens"] for r in out) * 0.4
    for d, goals in (("source", {"a": 0.4, "b": 0.3, "c": 0.3}), ("lang", {"x": 0.55, "y": 0.45}), ("topic", {"p": 0.5, "q": 0.5})):
        for value, share in goals.items():
            assert abs(sum(r["tokens"] * r["probability"] for r in out if r[d] == value) / total - share) < 0.01


# --- lines

def brute_lines(data):
    held = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    for n, (i, t) in enumerate(data):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add((i if i is not None else -(2**63), n))
    owner = {k: max(v)[0] for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in data:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if owner.get(key(x), i if i is not None else -(2**63)) == (i if i is not None else -(2**63))]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark, docs):
    got = lines.drop_repeated_lines(docs)
    want = brute_lines([(r[0], r[1]) for r in rows()])
    assert plain(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want and sum(w[2] for w in want) > 5
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())
    assert lines.drop_repeated_lines(empty(spark)).count() == 0


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    keys[1] = keys[0] + np.array([0, 1], np.uint64)  # one half alike
    index = lines.LineIndex(np.concatenate([keys, keys[:100]]), np.ones(5100, np.int64), np.arange(5100))
    assert sorted(index.hash.index(keys)) == list(range(5000))
    counts, owners = index.probe(keys)
    assert counts[:100].tolist() == [2] * 100 and owners[50] == 5050 and set(counts[100:]) == {1}
    assert index.probe(rng.integers(0, 1 << 63, (1000, 2), dtype=np.uint64))[0].sum() == 0


# --- byte strings

def brute_repeats(data, length=50):
    first = {}
    raw = [(2**63 - 1 if i is None else i, (t or "").encode(), i) for i, t in data]
    for i, b, _ in raw:
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], i), i)
    out = []
    for i, b, shown in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((shown, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, docs):
    got = suffix.remove_repeats(docs)
    want = brute_repeats([(r[0], r[1]) for r in rows()])
    assert plain(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want and sum(w[2] for w in want) > 1000
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_repeats_of_periodic_and_cut_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 400)
    rng = random.Random(8)
    parts = [prose(i, 30) for i in range(6)] + ["ab" * 120, "a" * 300, "é" * 90, "0123456789" * 20]
    data = [(i * 7 % 101, "".join(rng.choice(parts)[rng.randrange(20) :] + rng.choice(["", "|", "zz"]) for _ in range(rng.randrange(1, 9)))) for i in range(100)]
    got = suffix.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), texts=False)
    assert plain(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(data)


def test_repeats_of_a_hot_line(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_CONTEXTS", 3)
    line = prose(77, 14)
    data = [(i, f"{prose(500 + i, 12)}\n{line}\n{prose(700 + i % 5, 12)}") for i in range(60)]
    got = suffix.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), texts=False)
    assert plain(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(data)


def test_interval_expansion_groups():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(0, 2, 3000), [255]]).astype(np.uint8)
    group = suffix.repeated_groups(data, 12)
    raw = data.tobytes()
    seen = defaultdict(set)
    for i in range(len(raw) - 12):  # none reaches the end mark
        seen[raw[i : i + 12]].add(int(group[i]))
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


def test_groups_of_marked_texts_of_all_sizes():
    rng = np.random.default_rng(12)
    for size, letters in ((90_000, 3), (5_000, 60), (700, 1)):  # above and below 2^16 places
        data = rng.integers(0, letters, size).astype(np.uint8)
        for a, b, n in rng.integers(0, size - 200, (size // 100, 3)):
            data[b : b + n % 200] = data[a : a + n % 200]
        data[rng.integers(0, size, size // 90)] = data[-1] = 255
        ends = np.flatnonzero(data == 255)
        left = ends[np.searchsorted(ends, np.arange(size))] - np.arange(size)
        group, raw, seen = suffix.repeated_groups(data, 50, left), data.tobytes(), defaultdict(set)
        for i in np.flatnonzero(left >= 50).tolist():
            seen[raw[i : i + 50]].add(int(group[i]))
        assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


def test_repeats_gather_each_bucket_once(spark, monkeypatch, tmp_path):
    gather, calls = suffix._gather, str(tmp_path)

    def counted(group, hot):
        open(f"{calls}/{group['target'][0].as_py()}-{uuid.uuid4().hex}", "w").close()
        return gather(group, hot)

    monkeypatch.setattr(suffix, "_gather", counted)
    data = [(i, f"{prose(900 + i % 20, 30)} {prose(950 + i % 7, 30)}") for i in range(60)] + [(None, prose(901, 30)), (5, None)]
    got = suffix.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), texts=False)
    assert plain(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(data)
    buckets = [name.split("-")[0] for name in os.listdir(calls)]
    assert buckets and len(buckets) == len(set(buckets))


def test_classes_are_told_apart_and_found():
    rng = np.random.default_rng(4)
    anchor = rng.integers(0, 1 << 48, 50, dtype=np.uint64)[rng.integers(0, 50, 2000)]
    context = rng.integers(0, 2, 2000, dtype=np.uint64) << np.uint64(39) | rng.integers(0, 9, 2000, dtype=np.uint64)  # high parts alike
    order = suffix._class_order(anchor, context)
    both = list(zip(anchor[order].tolist(), context[order].tolist(), strict=True))
    assert sorted(order.tolist()) == list(range(2000)) and both == sorted(both)
    assert (np.diff(suffix._bucket(anchor[order], 7)) >= 0).all()
    keys = suffix.class_keys(anchor, context)
    rows, of = suffix._matches(keys, keys[:30])
    assert sorted(zip(rows.tolist(), of.tolist(), strict=True)) == [(i, j) for i in range(2000) for j in range(30) if keys[i] == keys[j]]


# --- personal data

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_rules_equal_plain_patterns():
    rng = random.Random(3)
    bits = ["a@b.co", "x@y", "@", ".", "-", " ", "+1 (724) 555-7058", "4813181876000285", "4539578763621486", "10.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "é", "+", "(", "0", "55", "joe.b@mail.example.com", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        want = [(k, m.start(), m.end()) for k, p in RULES.items() for m in re.finditer(p, text) if pii.sound(k, m.group())]
        assert pii.rule_spans(text)[0] == want, text


def test_rules_are_linear_on_long_runs():
    assert pii.rule_spans("1" * 200_000 + ".")[0] == [] and pii.rule_spans("a" * 200_000 + "@")[0] == []
    assert len(pii.rule_spans("9." * 100_000)[0]) == 25_000


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(6)
    made = lambda: rng.choice([f"jo{rng.randrange(99)}@mail{rng.randrange(9)}.org", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", ".".join(str(rng.randrange(256)) for _ in range(4))])
    codes, tags = [], []
    for i in range(500):
        text = f"{prose(i, 4)} {made()} {prose(i + 900, 20)}"[rng.randrange(9) :][: pii.WINDOW].ljust(pii.WINDOW, ".")
        codes.append(pii.encode(text))
        tags.append(pii.tags_of(pii.WINDOW, [x for x in pii.rule_spans(text)[0] if x[0] != "card"]))
    return pii.Tagger().fit(np.stack(codes), np.stack(tags), 5), np.stack(codes), np.stack(tags)


def test_tagger_learns_and_gradients_are_right(tagger):
    model, codes, tags = tagger
    found = np.stack([pii.viterbi(e.astype(float), model.w["trans"]) for e in model.scores(codes[:100])])
    assert (found == tags[:100])[tags[:100] > 0].mean() > 0.9
    small = pii.Tagger(1)
    _, grads = small._gradients(codes[:4], tags[:4])
    for name, at in (("xf", (2, 5)), ("hb", (3, 40)), ("out", (7, 2)), ("trans", (0, 1)), ("embed", (1, 3))):
        keep = small.w[name].copy()
        losses = []
        for step in (1e-2, -1e-2):
            small.w[name] = keep.copy()
            small.w[name][at] += step
            losses.append(small._gradients(codes[:4], tags[:4])[0])
        small.w[name] = keep
        assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][at]) < 0.02 * max(1, abs(grads[name][at]))


def test_personal_data(spark, docs, tagger):
    extra = spark.createDataFrame([(500, "call +1 (269) 555-3296 4524132264652876 or jo@x.org"), (501, prose(3, 90) + " 10.0.0.1 " + prose(4, 90))], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = {r["doc_id"]: r for r in pii.find_personal_data(every, tagger[0]).collect() if r["doc_id"] is not None}
    assert got[500]["n_email"] == 1 and got[501]["n_ip"] == 1 and got[60]["spans"] == ""
    for i, t in [(r[0], r[1]) for r in rows() if r[0] is not None] + [(500, extra.first()["text"])]:
        base = pii.joined(pii.rule_spans(t)[0])
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    assert pii.find_personal_data(empty(spark), None).count() == 0 and pii.train(empty(spark)) is None


def test_stretches_of_any_length_are_decoded_whole(tagger, monkeypatch):
    model = tagger[0]
    rng = random.Random(11)
    texts = ["".join(rng.choice("0123456789.@+- abc") for _ in range(n)) for n in (0, 5, 96, 97, 700, 9000)] + ["7" * 30_000, f"{prose(1, 300)} a@b.cc {prose(2, 300)} 1.2.3.4"]
    texts.append(" ".join([prose(3, 40), "+1 555 123 4567"] * 30))
    whole = []

    def plain_add(text, begin, tags, ruled, out):
        whole.append((begin, tags.tolist()))

    monkeypatch.setattr(pii, "_add", plain_add)
    want = []
    for text in texts:
        for _, starts in pii._stretches([text]):
            end = min(len(text), starts[-1] + pii.WINDOW)
            total, count = np.zeros((end - starts[0], pii.TAGS)), np.zeros((end - starts[0], 1))
            codes = np.full((len(starts), pii.WINDOW), 4, np.int64)
            for row, s in enumerate(starts):
                own = pii.encode(text[s : s + pii.WINDOW])
                codes[row, : len(own)] = own
            for s, scores in zip(starts, model.scores(codes), strict=True):
                size = min(pii.WINDOW, end - s)
                total[s - starts[0] : s - starts[0] + size] += scores[:size]
                count[s - starts[0] : s - starts[0] + size] += 1
            want.append((starts[0], pii.viterbi(total / count, model.w["trans"]).tolist()))
    for batch in (3, 64, 512, 10**6):
        monkeypatch.setattr(pii, "BATCH", batch)
        whole.clear()
        pii.added_spans(model, texts, [[] for _ in texts])
        assert [b for b, _ in whole] == [b for b, _ in want]
        same = sum(x == y for (_, a), (_, b) in zip(whole, want, strict=True) for x, y in zip(a, b, strict=True))
        assert same > 0.999 * sum(len(t) for _, t in want), batch



# --- licenses

def test_alignment():
    assert licenses.align("x a b c y".split(), "a b c".split()) == [(1, 0), (2, 1), (3, 2)]
    assert licenses.align("a b q c d".split(), "a b c d".split()) == [(0, 0), (1, 1), (3, 2), (4, 3)]
    pairs = licenses.align(prose(1, 300).split(), prose(1, 300).split()[50:250])
    assert len(pairs) == 200 and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))


def test_licenses(spark, docs):
    notice = licenses.TEMPLATES["apache-2.0-header"]
    broken = notice.replace("compliance", "accordance").replace("software distributed", "programs spread")
    data = [(1, f"{prose(1, 500)}\n{notice}\n{prose(2, 500)}"), (2, f"{prose(1, 50)} {broken} x"), (3, " ".join(["All rights reserved."] * 3)), (4, notice[:80]), (5, None), (6, ""), (7, "the mit license")]
    got = licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["license"], round(r["coverage"], 2)))
        text = dict(data)[r["doc_id"]]
        assert 0 <= r["start"] < r["end"] <= len(text)
    assert ("apache-2.0-header", 1.0) in by[1] and any(n == "apache-2.0-header" and c < 1 for n, c in by[2])
    assert by[3] == [("rights-reserved", 1.0)] * 3 and by[7] == [] and by[5] == [] and "apache-2.0-header" not in dict(by[4])
    assert licenses.scan_licenses(empty(spark)).count() == 0
    assert licenses.scan_licenses(docs.withColumn("coverage", F.lit(1))).count() == 0


def test_licenses_whole_texts_and_families():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        got = scanner.scan(f"{prose(3, 40)}\n{text}\n{prose(4, 40)}")
        assert (name, 1.0) in [(h[0], h[1]) for h in got], name
    names = lambda text: {h[0] for h in scanner.scan(text)}
    parts = licenses.TEMPLATES["mit-text"].split("\n\n")
    assert names(parts[1]) == {"mit-conditions"} and names(parts[2]) == {"mit-disclaimer"}
    assert names("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"} and names("Licensed under CC BY-NC-SA 3.0.") == {"cc-by-nc-sa-3.0"}
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == {"lgpl-3.0"}


@pytest.mark.parametrize("foreign", [13, 40, 200, 5000])
def test_licenses_over_gaps(foreign):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("mit-grant", "apache-2.0-header", "gpl-2.0-or-later-header", "mit-text", "gpl-3.0-text"):
        own = licenses.TEMPLATES[name].split()
        for cut in sorted({19, 22, 25, 29, len(own) // 2}):
            text = " ".join([prose(1, 30), *own[:cut], prose(2, foreign), *own[cut:], prose(3, 30)])
            assert any(h[0] == name and h[1] > 0.97 and h[3] - h[2] > len(" ".join(own)) for h in scanner.scan(text)), (name, cut)
    own = licenses.TEMPLATES["mit-text"].split()
    columns = " ".join(" ".join([*own[i : i + 12], prose(i, 8 + foreign % 30)]) for i in range(0, len(own), 12))
    assert any(h[0] == "mit-text" and h[1] > 0.9 for h in scanner.scan(columns))


def test_licenses_over_missing_words_and_copies():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    own = licenses.TEMPLATES["apache-2.0-header"].split()
    n = len([w for w, _, _ in licenses.words(" ".join(own))])
    for gone in (13, 14):
        for cut in range(25, 37):
            text = " ".join([prose(1, 60), *own[:cut], *own[cut + gone :], prose(2, 60)])
            left = len(licenses.words(" ".join(own[:cut] + own[cut + gone :]))) / n
            if left >= licenses.COVERAGE:
                assert any(h[0] == "apache-2.0-header" and h[1] >= left - 1e-9 for h in scanner.scan(text)), (gone, cut)
    own = licenses.TEMPLATES["mit-grant"].split()
    split = " ".join([*own[:22], prose(2, 50), *own[22:]])
    got = [h for h in scanner.scan(f"{' '.join(own)} {split} {split} {' '.join(own)} {' '.join(own[:22])}") if h[0] == "mit-grant"]
    assert [h[1] for h in got] == [1.0] * 4 and all(a[3] <= b[2] for a, b in zip(got, got[1:], strict=False))
    late = " ".join([*own[:38], prose(2, 50), *own[38:]])
    assert [h[1] for h in scanner.scan(late) if h[0] == "mit-grant"] == [1.0]
    assert scanner.scan(" ".join([*own[:22], prose(2, 50), *own[:22]])) == []


# --- pipeline

def test_pipeline_stages_keep_columns_and_empty_tables(spark, tmp_path):
    items = spark.createDataFrame([(1, prose(5, 60))], "item_id long, text string")
    for name, table in (("full", documents(spark)), ("none", empty(spark))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        seen = []
        for stage, fn in corpus_pipeline.STAGES:
            docs = fn(spark, docs, folder)
            docs.write.parquet(f"{folder}/{stage}")
            docs = spark.read.parquet(f"{folder}/{stage}")
            seen.append(docs.count())
            assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)
        assert seen == sorted(seen, reverse=True)
        assert (name == "none") == (seen[-1] == 0)
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/full/decontamination").collect()}
    assert 5 not in kept and 51 not in kept and 50 in kept


def test_hashes_of_words_follow_text_and_not_place():
    from seamwatch.llm.common import byte_views, word_hashes
    texts = pa.array(["the House", None, "", "  house\tTHE x", "the"])
    hashes, counts = word_hashes(*byte_views(texts))
    assert counts.tolist() == [2, 0, 0, 3, 1]
    assert hashes[0] == hashes[3] == hashes[5] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 3
