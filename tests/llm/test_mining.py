"""Divergence audit, collocations and byte-pair encoding against brute force and the public encoder."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamwatch.llm import bpe, collocations, divergence
from tests.llm.fixtures import SCHEMA, documents, empty, prose, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- divergence audit

def audit_by_hand(data, least, top=50):
    terms = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(LOWER))) for r in data]
    holders, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, words in terms:
        groups.add((lang, source))
        holders.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), n in holders.items() if x == lang and n >= least)
        own = {s: {w: counts[lang, s][w] for w in kept} for x, s in groups if x == lang}
        own[None] = {w: sum(c[w] for c in own.values()) for w in kept}
        p = {s: {w: 1 + (10**9 * (c[w] + 5)) // (sum(c.values()) + 5 * len(kept)) for w in kept} for s, c in own.items()}
        for s in own:
            if s is None:
                continue
            pairs = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in own if o not in (None, s)))
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            above = sorted((p[None][w] - p[s][w], w.encode()) for w in kept if own[s][w] and p[s][w] > p[None][w])
            out += [(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(above[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 3, 10_000])
def test_audit_equals_brute_force(docs, least):
    assert plain(divergence.audit(docs, least)) == audit_by_hand(rows(), least)


def test_audit_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUP_BLOCK", 3)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 8)
    monkeypatch.setattr(divergence, "SLICE", 5)
    rng = random.Random(4)
    data = [(i, prose(i % 70, rng.randint(0, 60)) + " Été ÉTÉ Ünï", rng.choice(["en", "EN", None]), rng.choice("abcdefgh") * 2, 0) for i in range(200)]
    got = plain(divergence.audit(spark.createDataFrame(data, SCHEMA).withColumn("term", F.lit(1)).withColumn("n", F.lit(2)), 4))
    assert got == audit_by_hand(data, 4)


def test_audit_of_nothing(spark):
    assert divergence.audit(empty(spark)).collect() == []


def test_share_is_exact_beyond_64_bits(spark):
    n, total, terms = 7_654_321_987_654, 9_876_543_210_123, 12_345_678
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


# --- collocations

def pieces(text):
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))) if w]


def collocations_by_hand(data, least, top):
    counts = defaultdict(Counter)
    for r in data:
        for words in pieces(r[1]):
            counts[r[2] if r[2] is not None else "und"].update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        kept = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        covered = {g[i : i + k] for g, a in kept.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if f[g[i : i + k]] <= a}
        best = []
        for g, a in kept.items():
            if g not in covered:
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, g.decode(), -a, left, right, n, -score) for i, (score, a, g, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out, key=repr)


def awkward():
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice(["new york city", "the", "The  light", "of\tthe", "stone. river", "é à", "naïve\x00word", "in,spite", "of it all"]) for _ in range(rng.randint(0, 80))),
             rng.choice(["en", "fr", None]), "a", 0) for i in range(120)]
    return [*data, (200, "same " * 5000, "en", "a", 0), (201, None, None, None, None), (202, " \n.,", "de", "a", 0), *rows()]


@pytest.mark.parametrize(("least", "top", "period"), [(3, 2000, 16), (8, 7, 2), (100, 2000, 16)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top, period):
    monkeypatch.setattr(collocations.parse, "__defaults__", (period, 40))
    monkeypatch.setattr(collocations, "COUNT_BYTES", 3000)
    monkeypatch.setattr(collocations, "PARSE_BYTES", 2000)
    data = awkward()
    table = spark.createDataFrame(data, SCHEMA).withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    got = collocations.mine(table, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert plain(got) == collocations_by_hand(data, least, top)


@pytest.mark.parametrize(("period", "longest"), [(1, 512), (2, 3), (16, 512), (10**9, 7)])
def test_parse_owns_every_phrase_once(period, longest):
    for data in awkward():
        text = (data[1] or "").encode().translate(collocations._TEXT_BYTES).split(b".")
        found = Counter()
        for chunk, extra in zip(*collocations.parse(text, period, longest), strict=True):
            words = chunk.as_py().split(" ")
            found.update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - extra) if i + m <= len(words))
        assert found == Counter(tuple(w[i : i + m]) for w in pieces(data[1]) for m in range(1, 6) for i in range(len(w) - m + 1))


def test_equal_passages_share_chunks(spark):
    passage = prose(9, 400)
    data = [(i, f"{prose(50 + i, 30)} {passage} {prose(80 + i, 30)}", "en", "a", 0) for i in range(20)]
    got = collocations.dictionary(spark.createDataFrame(data, SCHEMA)).collect()
    assert sum(len(r["chunk"]) for r in got) < 0.4 * sum(len(r[1]) for r in data)
    assert max(r["uses"] for r in got) >= 20


def test_full_filter_still_counts_exactly(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 6)
    monkeypatch.setattr(collocations.frequent_filter, "__defaults__", (1 << 6,))
    data = awkward()[:60]
    assert plain(collocations.mine(spark.createDataFrame(data, SCHEMA), 4, 100)) == collocations_by_hand(data, 4, 100)


def test_collocations_of_nothing(spark):
    assert collocations.mine(empty(spark)).collect() == []


# --- byte-pair encoding

@pytest.fixture(scope="module")
def vocabulary():
    with open(TOKENIZER, "rb") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


def ids_of(vocabulary, text, size, memory=None):
    return unpacked(b"".join(bpe.encode(vocabulary, text, memory, size)))


def test_streamed_tokens_equal_the_public_encoder(vocabulary, public):
    rng = random.Random(5)
    signs = ["'s", "'re", "'ll", "'", "  ", " ", "\n", "\t", "<|endoftext|>", "<|endof", "text|>", "é", "語", "a", "ab", " the", "12", "!!", "…", "\U0001f600", "e", "r", "\x00", "　", "\x85"]
    tokens = list(vocabulary.ids)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [b"".join(rng.choice(tokens) for _ in range(100)).decode("utf-8", "replace") for _ in range(60)]
    memory = bpe._Memory(vocabulary)
    for text, size in itertools.product(texts, (1, 2, 5, 13, 1 << 16)):
        assert ids_of(vocabulary, text, size, memory) == public.encode(text, add_special_tokens=False).ids, (text, size)


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 20_000 + "'s", " " * 40_000 + "x", "1" * 9000, "!" * 9000 + "'ll", " " * 5000 + "\n" * 5000 + " a", "é" * 20_000,
                                  "inging" * 9000 + " " + "-" * 9000, " " + "=" * 30_000 + "<|endoftext|>" * 3])
def test_long_runs_stream_in_bounded_memory(vocabulary, public, text):
    machine = bpe.StreamEncoder(vocabulary)
    got, held = b"", 0
    for chunk in bpe.chunks(text, 1000):
        got += machine.feed(chunk)
        held = max(held, len(machine.tail) + len(machine.held) + (len(machine.piece.window) if machine.piece else 0))
    assert unpacked(got + machine.finish()) == public.encode(text, add_special_tokens=False).ids
    assert held < 3 * bpe.LONG_PIECE


def test_lookahead_is_sufficient_for_random_merge_lists():
    rng = random.Random(6)
    letters = bpe.byte_letters()
    by_byte = {b: c for c, b in letters.items()}
    for trial in range(60):
        tokens, merges = [bytes([b]) for b in b"abc"], []
        while len(merges) < 25:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if (a, b) not in merges and len(a + b) < 9:
                merges.append((a, b))
                if a + b not in tokens:
                    tokens.append(a + b)
        spell = lambda t: "".join(by_byte[x] for x in t)
        every = [bytes([b]) for b in range(256)] + [t for t in tokens if len(t) > 1]
        spec = {"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False},
                "model": {"type": "BPE", "vocab": {spell(t): i for i, t in enumerate(every)}, "merges": [[spell(a), spell(b)] for a, b in merges]}}
        own = bpe.Vocabulary(json.dumps(spec).encode())
        for _ in range(20):
            text = bytes(rng.choice(b"abc") for _ in range(300))
            machine = bpe.PieceTransducer(own)
            machine.step = rng.randint(1, 40)
            whole = own.merge(text)
            assert machine.feed(text) + machine.finish() == whole == own._merge_short(text), (trial, own.lookahead)


def test_decoder_equals_the_public_decoder(vocabulary, public):
    rng = random.Random(7)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 40))]
        machine = bpe.StreamDecoder(vocabulary)
        got = "".join(machine.feed(bpe.pack([i])) for i in ids) + machine.finish()
        assert got == public.decode(ids, skip_special_tokens=False)


def test_tokens_of_all_documents(docs, public):
    table = docs.withColumn("ids", F.lit(1)).withColumn("value", F.lit("x"))
    got = bpe.tokenize(table, TOKENIZER).collect()
    want = Counter()
    for r in rows():
        ids = public.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in got) == want
    assert all((r["decoded"] or "").encode() and len(r["ids"]) == r["n_tokens"] for r in got if r["n_tokens"])


def test_tokens_of_nothing(spark):
    assert bpe.tokenize(empty(spark), TOKENIZER, outputs=False).collect() == []
