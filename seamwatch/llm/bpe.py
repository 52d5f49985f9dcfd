"""Byte-pair encoding and decoding as streams with a bounded lookahead.

A merge list has a *sufficient lookahead*: how many bytes after a token can still change it.  A
token is taken apart only by a merge of its last bytes with what follows, at an earlier place of
the list than the merges that built it, and what follows must itself survive until then.  One walk
through the list sums these chains (:func:`sufficient_lookahead`); for the public list of 50,000
merges it is 119 bytes.  The encoder is a transducer over this bound: it merges a window of bytes,
emits each token that has the lookahead behind it, and drops the window's front.  Texts are fed in
chunks, so a document or a run of letters of any length needs the same memory.

The text is first cut at the strings of added tokens, then into pieces (contractions, letters,
numbers, other signs, white space); both cuts are made as soon as the characters that could change
them have come.  Decoding is a second machine: token bytes go through an incremental UTF-8 decoder
that keeps an unfinished character and writes U+FFFD for bytes that belong to none.

A null text is empty and has no tokens; rows of one id count apart; text in the form of an added
token is that token.  Other columns of the documents, clashing ones too, are not read.  An empty
table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re as std_re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pieces that byte-level vocabularies are made for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that must follow a piece before it is final: a quote waits for two letters.
GUARD = 2
#: Characters fed at once, and the length from which an unfinished piece is passed on in parts.
CHUNK = 1 << 16
LONG_PIECE = 1 << 12
#: Windows up to which merges are searched in a plain list.
SHORT = 64
#: Pieces whose tokens a worker remembers (twice, the older ones until they are used again), and their greatest length.
REMEMBERED = 1 << 19
REMEMBERED_LENGTH = 64
_NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, as letter to byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token that decide whether it stays, at most.

    ``reach[t]`` is that number for token t over the merges walked so far.  The merge (u, v) can take
    u from its place if v survives until then; the token uv is decided by what decides v and, beyond
    v, u.
    """
    reach: dict[bytes, int] = {}
    for left, right in merges:
        before, after = reach.get(left, 0), reach.get(right, 0)
        reach[left] = max(before, len(right) + after)
        whole = left + right
        reach[whole] = max(reach.get(whole, 0), after, before - len(right))
    return max(reach.values(), default=0)


class Vocabulary:
    """Merges, ids and added tokens of a byte-level tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError("the file must hold a byte-level BPE model with the usual pieces and no prefix space")
        if spec.get("normalizer") or spec.get("post_processor") or any(
                model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("normalizers, post-processors and special merge options are not supported")
        letters = byte_letters()

        def raw_bytes(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.ids = {raw_bytes(t): i for t, i in model["vocab"].items()}
        pairs = [tuple(map(raw_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(pairs)
        #: (left id, right id) to the place in the list, and the id of the whole by place.
        self.merges = {(self.ids[a], self.ids[b]): place for place, (a, b) in enumerate(pairs)}
        self.wholes = [self.ids[a + b] for a, b in pairs]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.bytes = {i: t for t, i in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must match as they are")
        self.bytes |= {i: content.encode() for content, i in self.added.items()}
        sizes = np.zeros(max(self.bytes) + 1, np.int64)
        for i, t in self.bytes.items():
            sizes[i] = len(t)
        #: All token bytes end to end by id, with the start and size of each.
        self.table = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(len(sizes))), np.uint8), np.cumsum(sizes) - sizes, sizes
        self.added_pattern = std_re.compile("|".join(std_re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.added_length = max(map(len, self.added), default=0)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a window: the merge that comes first in the list, leftmost first, until none fits."""
        return self._merge_short(data) if len(data) <= SHORT else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        ids, get, wholes = [self.single[b] for b in data], self.merges.get, self.wholes
        places = [get(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while places:
            first = min(places)
            if first == _NEVER:
                break
            i = places.index(first)
            ids[i : i + 2] = [wholes[first]]
            del places[i]
            if i:
                places[i - 1] = get((ids[i - 1], ids[i]), _NEVER)
            if i < len(places):
                places[i] = get((ids[i], ids[i + 1]), _NEVER)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        ids, get, wholes = [self.single[b] for b in data], self.merges.get, self.wholes
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(place, i, pair[0], pair[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (place := get(pair)) is not None]
        heapify(heap)
        while heap:
            place, i, a, b = heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = wholes[place], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (found := get((ids[i], ids[k]))) is not None:
                    heappush(heap, (found, i, ids[i], ids[k]))
            k = left[i]
            if k >= 0 and (found := get((ids[k], ids[i]))) is not None:
                heappush(heap, (found, k, ids[k], ids[i]))
        return [i for i in ids if i >= 0]


class PieceTransducer:
    """Tokens of one piece, fed in parts; holds a window of bytes that some more can still change."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.window = b""
        self.step = 4 * max(vocabulary.lookahead, 16)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.step):
            self.window += data[at : at + self.step]
            stable = len(self.window) - self.vocabulary.lookahead
            done = 0
            for token in self.vocabulary.merge(self.window):
                end = done + len(self.vocabulary.bytes[token])
                if end > stable:
                    break
                out.append(token)
                done = end
            self.window = self.window[done:]
        return out

    def finish(self) -> list[int]:
        out = self.vocabulary.merge(self.window)
        self.window = b""
        return out


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memory(dict):
    """Packed tokens of pieces seen before; long pieces are not kept, and of a full memory the pieces stay that are used again."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            data = piece.encode()
            if len(data) > REMEMBERED_LENGTH:
                machine = PieceTransducer(self.vocabulary)
                return pack(machine.feed(data) + machine.finish())
            out = pack(self.vocabulary.merge(data))
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out


class StreamEncoder:
    """Packed token ids of a text that comes in chunks; ``feed`` and ``finish`` return what has become stable."""

    _pieces = regex.compile(PIECES)
    #: How a long piece goes on, by its last character.
    _more = tuple((regex.compile(at), regex.compile(more)) for at, more in (
        (r"\p{L}", r"\p{L}+"), (r"\p{N}", r"\p{N}+"), (r"\s", r"\s+"), (r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}]+")))

    def __init__(self, vocabulary: Vocabulary, memory: dict[str, bytes] | None = None):
        self.vocabulary = vocabulary
        self.memory = _Memory(vocabulary) if memory is None else memory
        self.held = ""  # characters that may belong to an added token
        self.tail = ""  # characters whose piece is not final
        self.piece: PieceTransducer | None = None  # of a long piece under way
        self.more = None

    def feed(self, chunk: str) -> bytes:
        out = b""
        text = self.held + chunk
        at = 0
        if self.vocabulary.added_pattern is not None:
            for m in self.vocabulary.added_pattern.finditer(text):
                out += self._segment(text[at : m.start()], True)
                out += pack([self.vocabulary.added[m.group()]])
                at = m.end()
        keep = self._possible(text, at)
        out += self._segment(text[at:keep], False)
        self.held = text[keep:]
        return out

    def finish(self) -> bytes:
        out = self._segment(self.held, True)
        self.held = ""
        return out

    def _possible(self, text: str, at: int) -> int:
        """From where the end of the text may begin an added token."""
        for i in range(max(at, len(text) - self.vocabulary.added_length + 1), len(text)):
            if any(t.startswith(text[i:]) for t in self.vocabulary.added):
                return i
        return len(text)

    def _segment(self, text: str, last: bool) -> bytes:
        text = self.tail + text
        out = b""
        if self.piece is not None:
            end = m.end() if (m := self.more.match(text)) else 0
            white = end and text[end - 1].isspace()
            whole = last or end < len(text)
            stop = end
            if white and end < len(text):
                stop = end - 1  # the last of the white space goes with what follows
            elif white and not last:
                stop = max(end - 1, 0)
            out += pack(self.piece.feed(text[:stop].encode()))
            text = text[stop:]
            if not whole:
                self.tail = text
                return out
            out += pack(self.piece.finish())
            self.piece = None
        if last:
            self.tail = ""
            return out + b"".join(map(self.memory.__getitem__, self._pieces.findall(text)))
        found = self._pieces.findall(text)
        ends = len(text)
        while found and ends + GUARD > len(text):
            ends -= len(found.pop())
        out += b"".join(map(self.memory.__getitem__, found))
        self.tail = text[ends:]
        if len(self.tail) >= LONG_PIECE:
            # Only one run of a kind can be left over at this length, perhaps with a final piece behind it.
            first = self._pieces.match(self.tail).group()
            if len(first) == len(self.tail):
                hold = 1 if first[-1].isspace() else 0
                self.piece = PieceTransducer(self.vocabulary)
                self.more = next(more for at, more in self._more if at.match(first[-1]))
                out += pack(self.piece.feed(first[: len(first) - hold].encode()))
                self.tail = first[len(first) - hold :]
        return out


class StreamDecoder:
    """Text of packed token ids that come in chunks; an unfinished character waits for its bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.joined, self.starts, self.sizes = vocabulary.table
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        sizes = self.sizes[ids]
        to = np.cumsum(sizes)
        at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(self.starts[ids] - to + sizes, sizes)
        return self.machine.decode(self.joined[at].tobytes())

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    for at in range(0, len(text), size):
        yield text[at : at + size]


def encode(vocabulary: Vocabulary, text: str | None, memory: dict | None = None, size: int = CHUNK) -> Iterator[bytes]:
    """Stable packed ids of a text, chunk by chunk."""
    machine = StreamEncoder(vocabulary, memory)
    for chunk in chunks(text or "", size):
        yield machine.feed(chunk)
    yield machine.finish()


_LOADED: dict[bytes, tuple[Vocabulary, dict]] = {}


def _loaded(raw: bytes) -> tuple[Vocabulary, dict]:
    """The vocabulary and memory of this worker process."""
    key = hashlib.sha256(raw).digest()
    if key not in _LOADED:
        vocabulary = Vocabulary(raw)
        _LOADED[key] = vocabulary, _Memory(vocabulary)
    return _LOADED[key]


def tokenize(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", outputs: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``outputs``, ids, decoded), one row for each document.

    ``path`` is a tokenizer file that the driver reads; its bytes (the file's size, whatever the
    documents) are broadcast.  One pass without a shuffle.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, memory = _loaded(shared.value)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), StreamDecoder(vocabulary)
                all_ids, all_text = [], []
                for packed in encode(vocabulary, value.as_py(), memory):
                    n += len(packed) // 4
                    ids_hash.update(packed)
                    part = decoder.feed(packed)
                    text_hash.update(part.encode())
                    if outputs:
                        all_ids.append(packed)
                        all_text.append(part)
                part = decoder.finish()
                text_hash.update(part.encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest(), np.frombuffer(b"".join(all_ids), "<u4"), "".join([*all_text, part])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            if outputs:
                arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    own = docs.selectExpr(f"cast(`{doc_id}` as long) AS doc_id", f"cast(`{text}` as string) AS text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if outputs else "")
    return own.mapInArrow(run, schema)
