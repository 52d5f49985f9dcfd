"""Removal of long repeated byte strings by threshold-bounded interval expansion.

Every byte string of ``LENGTH`` bytes has an anchor, the one of its ``GRAM``-byte strings with the
least hash (the last of equals); equal strings have equal anchors, so only places with equal
anchors need to be compared.  A run of neighbouring strings with one anchor is a context.

1. A parcel of documents sends its distinct contexts, as hashes of anchor and bytes with the least
   and largest doc_id, to the anchor's bucket.
2. A bucket gathers contexts by anchor.  A context alone under its anchor is settled: its least
   id.  For anchors with several contexts the bytes of one holder of each are asked for.
3. Those bytes are put end to end, blocks at a time.  From the suffix order and its
   Burrows-Wheeler transform, intervals are expanded backwards, breadth first: after step k the
   boundaries are those of common prefixes shorter than k, and step ``LENGTH`` is the last.  The
   intervals that are left are the strings that occur more than once, and the least id of each is
   known.
4. The verdicts go back to the parcels that hold the contexts, with what was settled in step 2, and
   bytes are marked and cut there.

An anchor with very many contexts, such as the first words of a line that a third of all documents
hold, would put them all in one task.  Its strings are sent one by one instead, each distinct one
once for a parcel, to the string's own bucket; there they are expanded like any other.

Contexts are told apart by 88 bits of hash, all else is exact.  A context that a third of all
documents hold is one entry for each parcel.  Null and empty texts, and texts below ``LENGTH``,
lose nothing.  Rows without an id rank after all others.  Rows of one id, and rows without an id,
never remove each other's bytes.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from seamwatch.llm.common import _MUL, _MUL2, _powers, byte_views, mix, parceled

LENGTH = 50
GRAM = 20
#: Bytes of texts that are worked on at a time, and of contexts whose suffixes are sorted together: work arrays
#: stay in a core's cache, and below 2^16 suffixes three ranks and a place fit into one number.
PIECE, BLOCK = 1 << 16, 3 << 14
#: Contexts of an anchor from which its strings go to buckets of their own.
HOT_CONTEXTS = 4096
_NO_ID = np.iinfo(np.int64).max
_CODES = np.random.default_rng(31337).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POSITION = np.uint64((1 << 24) - 1)
_END = 255  # in no UTF-8 text


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return zstandard.compress(b"".join(planes), 1)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    rows, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + rows * width].reshape(width, rows).T).view(kind).reshape(-1))
        at += rows * width
    return out


class Contexts:
    """The contexts of a run of texts: anchor and context hashes, document, and places in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        parts = [self._piece(data, offsets, at, to, length, gram) for at, to in _pieces(offsets, length)]
        names = ("anchor", "context", "doc", "first", "last", "place")
        for i, name in enumerate(names):
            kind = np.uint64 if i < 2 else np.int64
            setattr(self, name, np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind))

    @staticmethod
    def _piece(data, offsets, at, to, length, gram):
        part = data[at:to]
        n = len(part)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[part] * up[:n], out=total[1:])
        grams = total[gram:] - total[: n - gram + 1]
        grams *= down[: n - gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= _MUL2  # half of mix: the order of grams; the other half follows where it is an anchor
        least = grams & ~_POSITION
        least |= _POSITION - np.arange(len(grams), dtype=np.uint64)
        reach, width = 1, length - gram + 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        # strings that start in a text and end in it
        lo = np.searchsorted(offsets, at, "right") - 1
        hi = np.searchsorted(offsets, to, "left")
        starts = np.maximum(offsets[lo:hi], at) - at
        ends = np.minimum(offsets[lo + 1 : hi + 1], to) - at - length + 1
        some = ends > starts
        starts, ends = starts[some], ends[some]
        if not len(starts):
            return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 4
        # a run ends where the anchor changes or the text's strings end; the text starts anew after that
        sound = np.zeros(n - length + 2, np.int8)
        sound[starts] += 1
        sound[ends] -= 1
        sound = np.cumsum(sound[:-1], dtype=np.int8).view(bool)
        change = np.ones(len(least) + 1, bool)
        np.not_equal(least[1:], least[:-1], out=change[1:-1])
        change[starts] = True
        change[ends] = True
        first = np.flatnonzero(change[:-1] & sound)
        last = np.flatnonzero(change[1:] & sound)
        p = (_POSITION - (least[first] & _POSITION)).astype(np.int64)
        owner = np.searchsorted(offsets, first + at, "right") - 1
        anchor = grams[p]
        anchor = (anchor ^ (anchor >> np.uint64(29))) * _MUL
        anchor ^= anchor >> np.uint64(32)
        whole = (total[last + length] - total[first]) * down[first]
        shape = ((p - first) * 64 + (last - first)).astype(np.uint64)
        return [anchor >> np.uint64(16), mix(mix(whole) + shape) >> np.uint64(24), owner, first + at, last + at, p + at]

    def keys(self) -> np.ndarray:
        """One 64-bit key of anchor and context, for look-ups inside a parcel."""
        return class_keys(self.anchor, self.context)


def class_keys(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(anchor ^ mix(context))


def _pieces(offsets: np.ndarray, length: int):
    """Ranges of bytes of about ``PIECE``, cut between texts; a longer text is cut with an overlap."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        start, end = int(offsets[at]), int(offsets[to])
        while end - start >= length:
            yield start, min(end, start + 2 * PIECE)
            if start + 2 * PIECE >= end:
                break
            start += 2 * PIECE - length + 1
        at = to


def _load(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = group["doc_id"].fill_null(int(_NO_ID)).combine_chunks().to_numpy(zero_copy_only=False)
    data, offsets = byte_views(group["text"].combine_chunks())
    return ids, data, offsets


def _rows(target: list, kind: list, blob: list) -> pa.Table:
    return pa.table({"target": pa.array(target, pa.int32()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _cut(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Rows by key."""
    if len(keys) and keys.min() >= 0 and keys.max() < 1 << 16:
        keys = keys.astype(np.uint16)  # sorted by digits
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    return [(int(keys[run[0]]), run) for run in np.split(order, cuts) if len(run)]


def _class_order(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Rows by anchor (48 bits), then context (40 bits): sorted as one number, ties of its 64 bits once more."""
    key = anchor << np.uint64(16) | context >> np.uint64(24)
    order = np.argsort(key)
    ranked, rest = key[order], context[order]
    tie = ranked[1:] == ranked[:-1]
    if (tie & (rest[1:] < rest[:-1])).any():
        tied = np.zeros(len(order), bool)
        tied[1:] = tie
        tied[:-1] |= tie
        rows = order[tied]
        order[tied] = rows[np.lexsort((context[rows], key[rows]))]
    return order


def _matches(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``have``, row of ``wanted``) of all pairs of equal keys."""
    bits = max(16, 3 + len(wanted).bit_length())
    mask = np.uint64((1 << bits) - 1)
    some = np.zeros(1 << bits, bool)
    some[wanted & mask] = True
    rows = np.flatnonzero(some[have & mask])
    rows = rows[np.argsort(have[rows])]
    ranked = have[rows]
    lo, hi = np.searchsorted(ranked, wanted, "left"), np.searchsorted(ranked, wanted, "right")
    size = hi - lo
    of = np.repeat(np.arange(len(wanted)), size)
    return rows[np.repeat(lo, size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)], of


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


#: The anchors that are sent rise in a blob: the first, then the steps.
_SENT = ("uint64", "uint64", "int64", "int64")
_SETTLED = ("uint64", "int64")
_ASKED = ("uint64", "uint64", "int64", "int64")
_HELD = ("uint64", "uint64", "int32", "int64")
_VERDICT = ("uint64", "int16", "int16", "int64")
_STRING = ("uint64", "int64")
SETTLED, ASKED, HELD, HOT, STRING = range(5)


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """By the 32 bits above the low 16, so that buckets are ranges of anchors (48 bits)."""
    return (((anchor >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 8)[:, :width]


def _send(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        ids, data, offsets = _load(group)
        c = Contexts(data, offsets)
        doc = ids[c.doc]
        order = _class_order(c.anchor, c.context)
        anchor, context, doc = c.anchor[order], c.context[order], doc[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        at = np.flatnonzero(new)
        least, most = (f.reduceat(doc, at) if len(at) else doc for f in (np.minimum, np.maximum))
        anchor, context = anchor[new], context[new]
        most -= least
        bucket = _bucket(anchor, buckets)  # rising
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        cut = [(int(bucket[i]), slice(i, j)) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
        blobs = [pack(np.diff(anchor[i], prepend=np.uint64(0)), context[i], least[i], most[i]) for _, i in cut]
        return _rows([k for k, _ in cut], [group["parcel"][0].as_py()] * len(cut), blobs)

    return run


def _gather(group: pa.Table, hot_contexts: int) -> pa.Table:
    """Settle contexts that are alone under their anchor; ask for the bytes of the others."""
    bucket = group["target"][0].as_py()
    each = [unpack(b, *_SENT) for b in group["blob"].to_pylist()]
    parcel = np.repeat(np.asarray(group["kind"].to_pylist(), np.int32), [len(e[0]) for e in each])
    anchor = np.concatenate([np.cumsum(e[0]) for e in each])
    context, least, more = (np.concatenate([e[i] for e in each]) for i in range(1, 4))
    order = _class_order(anchor, context)
    shared = np.zeros(len(order), bool)  # an anchor of one entry that is of one document is of no use
    a = anchor[order]
    same = a[1:] == a[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared | (more[order] > 0)]
    anchor, context, least, most, parcel = anchor[order], context[order], least[order], (least + more)[order], parcel[order]
    if not len(order):
        return _rows([], [], [])
    new_anchor = np.ones(len(anchor), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new = new_anchor.copy()
    new[1:] |= context[1:] != context[:-1]
    starts = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    c_least, c_most = np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
    group_of = (np.cumsum(new_anchor) - 1)[starts]
    sizes = np.bincount(group_of)
    heads = np.flatnonzero(np.diff(group_of, prepend=-1))
    spread = np.maximum.reduceat(c_most, heads) > np.minimum.reduceat(c_least, heads)
    live = spread[group_of]  # some document is larger than another
    alone = live & (sizes[group_of] == 1)
    hot = live & (sizes[group_of] > hot_contexts)
    asked = live & (sizes[group_of] > 1) & ~hot
    target, kind, blob = [], [], []
    rows = np.flatnonzero(alone[of] & (most > c_least[of]))
    for p, i in _cut(parcel[rows]):
        r = rows[i]
        target.append(p)
        kind.append(SETTLED)
        blob.append(pack(class_keys(anchor[r], context[r]), c_least[of[r]]))
    rows = np.flatnonzero(hot[of])
    for p, i in _cut(parcel[rows]):
        target.append(p)
        kind.append(HOT)
        blob.append(pack(class_keys(anchor[rows[i]], context[rows[i]])))
    rows = np.flatnonzero(asked[of] & (least == c_least[of]))
    rows = rows[np.unique(of[rows], return_index=True)[1]]
    for p, i in _cut(parcel[rows]):
        r = rows[i]
        target.append(p)
        kind.append(ASKED)
        blob.append(pack(anchor[r], context[r], least[r], c_most[of[r]]))
    rows = np.flatnonzero(asked[of])
    if len(rows):
        target.append(bucket)
        kind.append(HELD)
        blob.append(pack(anchor[rows], context[rows], parcel[rows], most[rows]))
    return _rows(target, kind, blob)


def _blobs(group: pa.Table, kind: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    found = [unpack(b, *kinds) for b, k in zip(group["blob"].to_pylist(), group["kind"].to_pylist(), strict=True) if k == kind]
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate(kinds)]


def _strings(c: Contexts, data: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context row, start) of every string of the contexts with these keys."""
    row = np.sort(_matches(c.keys(), np.unique(keys))[0])
    sizes = c.last[row] - c.first[row] + 1
    start = _ranges(c.first[row], sizes)
    words = np.ndarray(max(0, len(data) - 7), np.uint64, np.ascontiguousarray(data), 0, (1,))  # the 8 bytes from each place
    found = np.zeros(len(start), np.uint64)
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        found = mix(found + words[start + at])
    return found, np.repeat(row, sizes), start


def _hot_contexts(c: Contexts, ids: np.ndarray, data: np.ndarray, keys: np.ndarray):
    """The parcel's distinct strings of hot anchors: hash, least and largest id, one start."""
    found, row, start = _strings(c, data, keys)
    order = np.argsort(found)
    found, doc, start = found[order], ids[c.doc[row[order]]], start[order]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return found, doc, doc, start
    return found[at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at), start[at]


def _fetch(buckets: int):
    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        anchor, context, doc, most = _blobs(told, ASKED, _ASKED)
        hot = _blobs(told, HOT, ("uint64",))[0]
        if not (len(anchor) or len(hot)) or not group.num_rows:
            return _rows([], [], [])
        parcel = group["parcel"][0].as_py()
        if not len(hot):
            ids = group["doc_id"].fill_null(int(_NO_ID)).combine_chunks().to_numpy(zero_copy_only=False)
            group = group.filter(pa.array(np.isin(ids, doc)))
        ids, data, offsets = _load(group)
        c = Contexts(data, offsets)
        wanted = class_keys(anchor, context) ^ mix(doc.view(np.uint64))
        have = c.keys() ^ mix(ids[c.doc].view(np.uint64))
        row, fits = _matches(have, wanted)
        fits, one = np.unique(fits, return_index=True)
        row = row[one]
        anchor, context, doc, most = anchor[fits], context[fits], doc[fits], most[fits]
        first, sizes, lead = c.first[row], c.last[row] - c.first[row] + LENGTH, c.place[row] - c.first[row]
        holder = np.full(len(row), -1, np.int32)
        if len(hot):
            h, h_least, h_most, h_first = _hot_contexts(c, ids, data, hot)
            anchor, context, doc, most = (np.concatenate(x) for x in ((anchor, h), (context, h), (doc, h_least), (most, h_most)))
            first, sizes, lead, holder = (np.concatenate([x, y]) for x, y in (
                (first, h_first), (sizes, np.full(len(h), LENGTH)), (lead, np.zeros(len(h), np.int64)), (holder, np.full(len(h), parcel, np.int32))))
        target, kind, blob = [], [], []
        for b, i in _cut(_bucket(anchor, buckets)):
            raw = data[_ranges(first[i], sizes[i])].tobytes()
            head = pack(anchor[i], context[i], doc[i], most[i], sizes[i].astype(np.int16), lead[i].astype(np.int16), holder[i])
            target.append(b)
            kind.append(len(head))
            blob.append(head + zstandard.compress(raw, 1))
        return _rows(target, kind, blob)

    return run


def _side_by_side(rank: np.ndarray, known: int, width: int, many: int) -> np.ndarray:
    """The ranks (``width`` bits) of each place and of the next ones ``known`` bytes apart, ``many`` in one number."""
    key, have = rank, 1
    while have < many:
        step = min(have, many - have)
        later = np.zeros(len(key), np.uint64)
        later[: max(0, len(key) - have * known)] = key[have * known :]
        key = key << np.uint64(width * step) | later >> np.uint64(width * (have - step))
        have += step
    return key


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Places of ``data`` by their first ``depth`` bytes at least, and what was known before the last sort.

    That is a number of bytes below ``depth`` and the rank of each place by as many.  Each sort puts as
    many ranks side by side as 64 bits hold beside the place, two at least.
    """
    n = len(data)
    used = np.zeros(256, bool)
    used[data] = True
    code = np.cumsum(used).astype(np.uint64)
    rank, known = code[data], 1
    bits, width = n.bit_length(), int(code[-1]).bit_length()
    places = np.arange(n, dtype=np.uint64)
    while True:
        many = max(2, (64 - bits) // width)
        key = _side_by_side(rank, known, width, many)
        # any order of equal prefixes will do: no boundary depends on it
        if many * width + bits <= 64:
            key = key << np.uint64(bits) | places
            key.sort()
            order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            key >>= np.uint64(bits)
        else:
            order = np.argsort(key)
            key = key[order]
        if known * many >= depth:
            return order, known, rank
        fresh = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh, dtype=np.uint64)
        known, width = known * many, bits


def _edges(interval: np.ndarray) -> np.ndarray:
    """Where intervals begin, and the end."""
    edge = np.ones(len(interval) + 1, bool)
    np.not_equal(interval[1:], interval[:-1], out=edge[1:-1])
    return edge


def _intervals(edge: np.ndarray) -> np.ndarray:
    """The interval of each suffix from 1 on, and 0 for those that were left out."""
    interval = np.zeros(len(edge), np.int32)
    np.cumsum(edge[:-1], dtype=np.int32, out=interval[:-1])
    return interval


def repeated_groups(data: np.ndarray, length: int = LENGTH, left: np.ndarray | None = None) -> np.ndarray:
    """A group number for each place: equal numbers where the ``length`` bytes from there are equal.

    Boundaries between suffixes are found by the length of what they share, shortest first, from the
    length that the sort knows on.  The transform tells where the suffix stands that a suffix extends
    by a byte in front: neighbours of one byte are parted after step k + 1 if those are parted after
    step k.  A suffix alone between its boundaries is so for good, and what it extends to is so after
    the next step; such suffixes are left out.  With ``left``, bytes to the next end mark, so are those
    that a step passes the end mark of; their numbers mean nothing.
    """
    n = len(data)
    order, known, rank = suffix_order(data, length)
    if left is not None:
        order = order[left[order] >= known]
    size = len(order)
    at = np.full(n + 1, size)
    at[order] = np.arange(size)
    follow = at[order + 1]
    edge = _edges(rank[order])  # edge[i]: suffixes i - 1 and i differ in what has been read
    for step in range(known, length + 1):
        interval = _intervals(edge)
        if step % 4 == 0 or step <= known + 1:
            gone = edge[1:] & edge[:-1]
            if left is not None:
                gone |= left[order] < step
            if 4 * np.count_nonzero(gone) > size:
                keep = np.flatnonzero(~gone)
                at = np.full(size + 1, len(keep))
                at[keep] = np.arange(len(keep))
                follow, order, size = at[follow[keep]], order[keep], len(keep)
                edge = _edges(interval[keep])
                interval = _intervals(edge)
        if step == length:
            break
        value = interval[follow]
        split = value[1:] != value[:-1]
        split |= value[1:] == 0
        split &= ~edge[1:-1]
        if not split.any():
            break
        edge[1:-1] |= split
    group = np.arange(n)
    if size:
        group[order] = order[np.flatnonzero(edge[:-1])][interval[:-1] - 1]
    return group


def _expand(group: pa.Table, told: pa.Table) -> pa.Table:
    """Least ids of the asked contexts' strings, sent to all parcels that hold the contexts.

    What ``_gather`` told the parcel of the bucket's number is passed on with them, so that it is
    gathered once and the last pass has one table beside the texts.
    """
    passed = told.filter(pa.array(np.isin(told["kind"].to_numpy(), (SETTLED, HOT)))).select(["target", "kind", "blob"])
    if not group.num_rows:
        return passed
    heads, raws = [], []
    for size, blob in zip(group["kind"].to_pylist(), group["blob"].to_pylist(), strict=True):
        heads.append(unpack(blob[:size], "uint64", "uint64", "int64", "int64", "int16", "int16", "int32"))
        raws.append(np.frombuffer(zstandard.decompress(blob[size:]), np.uint8))
    anchor, context, doc, most, sizes, lead, sender = (np.concatenate([h[i] for h in heads]) for i in range(7))
    sizes = sizes.astype(np.int64)
    data = np.concatenate(raws)
    ends = np.cumsum(sizes)
    order = np.argsort(anchor)
    weight = np.cumsum(sizes[order] + 1) // BLOCK
    keep_whole = np.ones(len(order), bool)
    keep_whole[1:] = anchor[order][1:] != anchor[order][:-1]
    block = np.maximum.accumulate(np.where(keep_whole, weight, -1))
    cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
    found = [_least_ids(data, ends, sizes, doc, most, lead, rows) for rows in np.split(order, cuts)]
    row, low, high, least = (np.concatenate([f[i] for f in found]) for i in range(4))
    h_anchor, h_context, h_parcel, h_most = _blobs(told, HELD, _HELD)
    mine, theirs = class_keys(anchor[row], context[row]), class_keys(h_anchor, h_context)
    holder, verdict = _matches(theirs, mine)
    useful = h_most[holder] > least[verdict]
    verdict, holder = verdict[useful], holder[useful]
    target, kind, blob = [], [], []
    own = np.flatnonzero(sender[row] >= 0)
    for p, i in _cut(sender[row[own]]):
        v = own[i]
        target.append(p)
        kind.append(STRING)
        blob.append(pack(anchor[row[v]], least[v]))
    for p, i in _cut(h_parcel[holder]):
        v = verdict[i]
        target.append(p)
        kind.append(HELD)
        blob.append(pack(mine[v], low[v].astype(np.int16), high[v].astype(np.int16), least[v]))
    found = _rows(target, kind, blob)
    return pa.concat_tables([found, passed.cast(found.schema)])


def _least_ids(data, ends, sizes, doc, most, lead, rows):
    """Runs of strings of one least id in the contexts ``rows``: (row, low, high, least), places relative to the anchor."""
    size = sizes[rows]
    length = size + 1
    inside = _ranges(np.zeros(len(rows), np.int64), length)
    left = np.repeat(size, length) - inside
    text = np.full(len(inside), _END, np.uint8)
    text[left > 0] = data[_ranges(ends[rows] - size, size)]
    group = repeated_groups(text, LENGTH, left)
    owner = np.repeat(np.arange(len(rows)), length)
    strings = np.flatnonzero(left >= LENGTH)
    least = np.full(len(text), _NO_ID)
    np.minimum.at(least, group[strings], doc[rows][owner[strings]])
    value, own = least[group[strings]], owner[strings]
    new = np.ones(len(strings), bool)
    new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(strings)]]) - 1
    own, value = own[head], value[head]
    use = value < most[rows][own]
    shift = lead[rows][own].astype(np.int64)
    low, high = inside[strings[head]] - shift, inside[strings[tail]] - shift
    return rows[own][use], low[use], high[use], value[use]


def _remove(texts: bool):
    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        ids, data, offsets = _load(group)
        s_key, s_least = _blobs(told, SETTLED, _SETTLED)
        v_key, v_low, v_high, v_least = _blobs(told, HELD, _VERDICT)
        mark = np.zeros(len(data) + 1, np.int32)
        c = Contexts(data, offsets) if told.num_rows else None
        if len(s_key) or len(v_key):
            key = np.concatenate([s_key, v_key])
            whole = np.concatenate([np.ones(len(s_key), bool), np.zeros(len(v_key), bool)])
            low, high = (np.concatenate([np.zeros(len(s_key), np.int64), x.astype(np.int64)]) for x in (v_low, v_high))
            least = np.concatenate([s_least, v_least])
            row, v = _matches(c.keys(), key)
            later = ids[c.doc[row]] > least[v]
            v, row = v[later], row[later]
            begin = np.where(whole[v], c.first[row], c.place[row] + low[v])
            end = np.where(whole[v], c.last[row], c.place[row] + high[v]) + LENGTH
            np.add.at(mark, begin, 1)
            np.subtract.at(mark, end, 1)
        hot, (t_hash, t_least) = _blobs(told, HOT, ("uint64",))[0], _blobs(told, STRING, _STRING)
        if len(t_hash):
            found, row, start = _strings(c, data, hot)
            one, v = _matches(found, t_hash)
            start = start[one][t_least[v] < ids[c.doc[row[one]]]]
            np.add.at(mark, start, 1)
            np.subtract.at(mark, start + LENGTH, 1)
        gone = np.cumsum(mark[:-1], dtype=np.int32) > 0
        n_removed, n_spans, digests, kept_texts = [], [], [], []
        for s, e in zip(offsets[:-1], offsets[1:], strict=True):
            lost = gone[s:e]
            kept = data[s:e] if not lost.any() else data[s:e][~lost]
            n_removed.append(int(e - s - len(kept)))
            n_spans.append(int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum()))
            digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
            kept_texts.append(kept.tobytes() if texts else None)
        out = {"doc_id": group["doc_id"], "n_bytes": pa.array(np.diff(offsets).astype(np.int64)), "n_removed": pa.array(n_removed, pa.int64()),
               "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept_texts, pa.binary())} if texts else {}))

    return run


_TOLD = "target int, kind int, blob binary"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept), one row for each document."""
    parcels, count = parceled(docs, doc_id, text)
    by_parcel = parcels.groupBy("parcel")
    sent = by_parcel.applyInArrow(_send(count), _TOLD)
    hot = HOT_CONTEXTS
    told = sent.groupBy("target").applyInArrow(lambda group: _gather(group, hot), _TOLD).repartition(count, "target")
    fetched = by_parcel.cogroup(told.groupBy("target")).applyInArrow(_fetch(count), _TOLD)
    verdicts = fetched.groupBy("target").cogroup(told.groupBy("target")).applyInArrow(_expand, _TOLD)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return by_parcel.cogroup(verdicts.groupBy("target")).applyInArrow(_remove(texts), schema)
