"""Line deduplication by a sharded minimal perfect hash.

Documents are dealt into parcels.  A parcel sends each of its distinct line keys, as a 128-bit
hash with its number of documents and largest id, to the hash's shard.  A shard builds a minimal
perfect hash over its distinct keys, which indexes three compact arrays: fingerprints, document
counts and largest ids.  The parcels' keys then probe the arrays (no line is joined with another,
and a line of a third of all documents is one entry for each parcel), and what they find goes
back to the parcels, where the lines are dropped.

A line's key is the line without white space at its ends and with A-Z as a-z.  Null and empty
texts are one empty line.  A line that a document repeats counts once for it; rows of one id count
apart and, if the id is the largest, all keep the line.  Null ids are smaller than any other.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from seamwatch.llm.common import mix, parceled

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
#: Parcels whose keys one shard takes, on average.
PARCELS_PER_SHARD = 4
_WHITE = b"\x20\t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NO_ID = np.iinfo(np.int64).min
#: Bits of a level for each key that reaches it.
_ROOM = 1.6


def line_key(line: bytes, least: int = MIN_LENGTH) -> bytes | None:
    """The 128-bit hash of a line's key, None if the key is short."""
    if len(line) < least:
        return None
    key = line.strip(_WHITE)
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return xxhash.xxh3_128_digest(key.translate(_LOWER))


class PerfectHash:
    """Minimal perfect hash of 128-bit keys: levels of bits in which a key that is alone is at home."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = keys, 0
        while len(left):
            size = math.ceil(len(left) * _ROOM / 64) * 64
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, base + np.cumsum(counts) - counts))
            base += int(alone.sum())
            left = left[~alone]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers from 0 of known keys; an unknown key gets some number or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(keys[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            home = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[home]] = (ranks[word] + below)[home]
            open_ = open_[~home]
        return out


class LineIndex:
    """A shard: fingerprint, count and largest id of each distinct key."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, counts, owners = keys[order], counts[order], owners[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        distinct = keys[new]
        self.hash = PerfectHash(distinct)
        at = self.hash.index(distinct)
        self.prints = np.empty(len(distinct), np.uint32)
        self.counts = np.empty(len(distinct), np.int64)
        self.owners = np.empty(len(distinct), np.int64)
        self.prints[at] = (distinct[:, 1] >> np.uint64(32)).astype(np.uint32)
        self.counts[at] = np.add.reduceat(counts, starts) if len(starts) else 0
        self.owners[at] = np.maximum.reduceat(owners, starts) if len(starts) else 0

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and largest id of each key, 0 where the fingerprint tells that the key is unknown."""
        at = self.hash.index(keys)
        known = (at >= 0) & (self.prints[at] == (keys[:, 1] >> np.uint64(32)).astype(np.uint32))
        return np.where(known, self.counts[at], 0), np.where(known, self.owners[at], _NO_ID)


def _raw_lines(texts: pa.ChunkedArray):
    for value in texts:
        text = value.as_py()
        yield (text or "").encode().split(b"\n")


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(int(_NO_ID)).combine_chunks().to_numpy(zero_copy_only=False)


def _send(shards: int):
    def run(group: pa.Table) -> pa.Table:
        held: dict[bytes, list[int]] = {}
        for doc, lines in zip(_ids(group["doc_id"]).tolist(), _raw_lines(group["text"]), strict=True):
            for key in {line_key(x) for x in lines}:
                if key is not None:
                    had = held.get(key)
                    if had is None:
                        held[key] = [1, doc]
                    else:
                        had[0] += 1
                        had[1] = max(had[1], doc)
        keys = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
        counts = np.fromiter((v[0] for v in held.values()), np.int64, len(held))
        owners = np.fromiter((v[1] for v in held.values()), np.int64, len(held))
        shard = (keys[:, 0] % np.uint64(shards)).astype(np.int32)
        picked = [(s, np.flatnonzero(shard == s)) for s in np.unique(shard)]
        return pa.table({
            "shard": pa.array([s for s, _ in picked], pa.int32()), "parcel": pa.array([group["parcel"][0].as_py()] * len(picked), pa.int32()),
            "keys": pa.array([keys[i].tobytes() for _, i in picked], pa.binary()),
            "counts": pa.array([counts[i].tobytes() for _, i in picked], pa.binary()), "owners": pa.array([owners[i].tobytes() for _, i in picked], pa.binary())})

    return run


def _shard(least: int):
    def run(group: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in group["keys"].to_pylist()]
        index = LineIndex(np.concatenate(each), *(np.concatenate([np.frombuffer(x, np.int64) for x in group[c].to_pylist()]) for c in ("counts", "owners")))
        parcels, keys, owners = [], [], []
        for parcel, own in zip(group["parcel"].to_pylist(), each, strict=True):
            counts, largest = index.probe(own)
            often = counts >= least
            if often.any():
                parcels.append(parcel)
                keys.append(own[often].tobytes())
                owners.append(largest[often].tobytes())
        return pa.table({"parcel": pa.array(parcels, pa.int32()), "keys": pa.array(keys, pa.binary()), "owners": pa.array(owners, pa.binary())})

    return run


def _drop(texts: bool):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        owner: dict[bytes, int] = {}
        for keys, owners in zip(answers["keys"].to_pylist(), answers["owners"].to_pylist(), strict=True):
            owner.update(zip((keys[i : i + 16] for i in range(0, len(keys), 16)), np.frombuffer(owners, np.int64).tolist(), strict=True))
        n_lines, n_dropped, digests, kept_texts = [], [], [], []
        for doc, lines in zip(_ids(group["doc_id"]).tolist(), _raw_lines(group["text"]), strict=True):
            kept = lines if not owner else [x for x in lines if owner.get(line_key(x), doc) == doc]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            whole = b"\n".join(kept)
            digests.append(hashlib.sha256(whole).hexdigest())
            kept_texts.append(whole.decode() if texts else None)
        out = {"doc_id": group["doc_id"], "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept_texts, pa.string())} if texts else {}))

    return run


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = MIN_DOCUMENTS, texts: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256 and, with ``texts``, kept_text), one row for each document."""
    parcels, count = parceled(docs, doc_id, text)
    shards = math.ceil(count / PARCELS_PER_SHARD)
    sent = parcels.groupBy("parcel").applyInArrow(_send(shards), "shard int, parcel int, keys binary, counts binary, owners binary")
    answers = sent.groupBy("shard").applyInArrow(_shard(documents), "parcel int, keys binary, owners binary")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if texts else "")
    return parcels.groupBy("parcel").cogroup(answers.groupBy("parcel")).applyInArrow(_drop(texts), schema)
