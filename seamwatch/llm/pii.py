"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers.  The tagger learns
the rules' spans on a bounded sample of windows and adds spans where the rules' greedy matches
fail, such as a phone number that runs into a card number.  It reads windows that overlap by half;
a character's scores are averaged over the windows that hold it, and each stretch of windows is
decoded as a whole, so no span depends on where a window ends.  Only windows with a digit or an
``@`` are read, since no span of these kinds can be without one.  An added span must meet its
kind's checks and must not touch a span of that kind by the rules.

Places count code points, ends exclusive.  Null and empty texts have no span.  Repeated rows are
tagged alike.  An empty table, or one whose sample holds no span, gives no added spans.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and the step from one to the next.
WINDOW, STEP = 96, 48
#: Windows that are scored at once.
BATCH = 512
#: Rows whose windows are learned from, and windows at most.
SAMPLE_ROWS, SAMPLE_WINDOWS = 20_000, 1600
EPOCHS, BATCH, HIDDEN, EMBED = 8, 32, 16, 10

_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match cannot start inside a number: its rest would match as well
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def sound(kind: str, value: str) -> bool:
    """The checks that a match of its kind must pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in value.split("."))
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return 8 <= len(digits) <= 15


def _emails(text: str):
    """Leftmost matches that do not overlap; each starts as far left of its ``@`` as it may."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def rule_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Spans by the rules, in the order of KINDS, and the matches that failed their checks."""
    if not text or not _TRIGGER.search(text):
        return [], []
    spans, failed = [("email", s, e) for s, e in _emails(text)], []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            if sound(kind, m.group()):
                spans.append((kind, m.start(), m.end()))
            elif kind == "phone" or m.end() - m.start() >= 16:
                failed.append(m.span())
    return spans, failed


# Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_SYMBOLS = "@.-+()_% :/=,;"
CODES = len(_SYMBOLS) + 5


def encode(text: str) -> np.ndarray:
    """A small code for each character: digit, lower, upper, other letter, other, or a symbol's own."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.full(len(points), 4, np.int64)
    out[(points >= 48) & (points <= 57)] = 0
    out[(points >= 97) & (points <= 122)] = 1
    out[(points >= 65) & (points <= 90)] = 2
    out[points > 127] = 3
    for i, c in enumerate(_SYMBOLS):
        out[points == ord(c)] = 5 + i
    return out


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, s, e in spans:
        k = KINDS.index(kind)
        out[s] = 1 + 2 * k
        out[s + 1 : e] = 2 + 2 * k
    return out


def window_starts(text: str) -> list[int]:
    """Starts, on the grid of STEP, of all windows that hold a trigger."""
    found: set[int] = set()
    for m in _TRIGGER.finditer(text):
        cell = m.start() // STEP
        found.add(cell * STEP)
        if cell:
            found.add((cell - 1) * STEP)
    return sorted(found)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Bidirectional LSTM over character codes with a linear-chain CRF on top."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"embed": draw(CODES, EMBED), "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for side in ("f", "b"):
            self.w[f"x{side}"], self.w[f"h{side}"] = draw(EMBED, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
            self.w[f"c{side}"] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)  # forget gates start open

    def _run(self, codes: np.ndarray, side: str, keep: bool):
        """Hidden states (time, batch, hidden) and, to train, what the way back needs."""
        w, (n, t) = self.w, codes.shape
        gates = (w["embed"] @ w[f"x{side}"] + w[f"c{side}"])[codes]
        h = c = np.zeros((n, HIDDEN), np.float32)
        states, past = np.empty((t, n, HIDDEN), np.float32), []
        for i in range(t) if side == "f" else range(t - 1, -1, -1):
            z = gates[:, i] + h @ w[f"h{side}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            a, g = np.tanh(z[:, 3 * HIDDEN :]), s
            new = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * a
            if keep:
                past.append((i, g, a, c, new, h))
            c = new
            h = g[:, 2 * HIDDEN :] * np.tanh(c)
            states[i] = h
        return states, past

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Tag scores (batch, time, tag)."""
        both = np.concatenate([self._run(codes, s, False)[0] for s in "fb"], axis=2)
        return (both @ self.w["out"] + self.w["out_b"]).transpose(1, 0, 2)

    def _gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, (n, t) = self.w, codes.shape
        runs = {s: self._run(codes, s, True) for s in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        emit = (both @ w["out"] + w["out_b"]).astype(np.float64)
        loss, d_emit, d_trans = _crf(emit, w["trans"].astype(np.float64), tags.T)
        d_emit = (d_emit / n).astype(np.float32)
        grads = {"trans": (d_trans / n).astype(np.float32), "out": np.tensordot(both, d_emit, ([0, 1], [0, 1])), "out_b": d_emit.sum((0, 1))}
        d_both = d_emit @ w["out"].T
        d_embed = np.zeros_like(w["embed"])
        for at, s in enumerate("fb"):
            d_states = d_both[:, :, at * HIDDEN : (at + 1) * HIDDEN]
            d_h = d_c = np.zeros((n, HIDDEN), np.float32)
            d_hw, d_gates = np.zeros_like(w[f"h{s}"]), np.zeros((CODES, 4 * HIDDEN), np.float32)
            for i, g, a, c, new, h in reversed(runs[s][1]):
                d_h = d_h + d_states[i]
                out, tc = g[:, 2 * HIDDEN :], np.tanh(new)
                d_c = d_c + d_h * out * (1 - tc * tc)
                d_g = np.concatenate([d_c * a, d_c * c, d_h * tc], axis=1) * g * (1 - g)
                d_z = np.concatenate([d_g, d_c * g[:, :HIDDEN] * (1 - a * a)], axis=1)
                d_hw += h.T @ d_z
                np.add.at(d_gates, codes[:, i], d_z)
                d_h, d_c = d_z @ w[f"h{s}"].T, d_c * g[:, HIDDEN : 2 * HIDDEN]
            grads[f"h{s}"], grads[f"c{s}"], grads[f"x{s}"] = d_hw, d_gates.sum(0), w["embed"].T @ d_gates
            d_embed += d_gates @ w[f"x{s}"].T
        grads["embed"] = d_embed
        return loss / n, grads

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02) -> Tagger:
        """Adam on the CRF's likelihood; a fixed seed makes runs repeat."""
        rng = np.random.default_rng(11)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                _, grads = self._gradients(codes[rows], tags[rows])
                step += 1
                now = rate * (1 - epoch / epochs) + 1e-3
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _crf(emit: np.ndarray, trans: np.ndarray, tags: np.ndarray):
    """Negative log likelihood of the tags (time, batch) and its gradients."""
    t, n, _ = emit.shape
    ahead, behind = np.empty_like(emit), np.zeros_like(emit)
    ahead[0] = emit[0]
    for i in range(1, t):
        ahead[i] = _log_sum(ahead[i - 1][:, :, None] + trans, 1) + emit[i]
    for i in range(t - 2, -1, -1):
        behind[i] = _log_sum(trans + (emit[i + 1] + behind[i + 1])[:, None, :], 2)
    whole = _log_sum(ahead[-1], 1)
    d_emit = np.exp(ahead + behind - whole[:, None])
    pairs = np.exp(ahead[:-1][:, :, :, None] + trans + (emit[1:] + behind[1:])[:, :, None, :] - whole[:, None, None])
    d_trans = pairs.sum((0, 1))
    rows = np.arange(n)
    gold = emit[np.arange(t)[:, None], rows, tags].sum() + trans[tags[:-1], tags[1:]].sum()
    np.subtract.at(d_emit, (np.arange(t)[:, None], rows[None, :], tags), 1)
    np.subtract.at(d_trans, (tags[:-1], tags[1:]), 1)
    return float(whole.sum() - gold), d_emit, d_trans


class Viterbi:
    """The best tags of one stretch whose scores come in parts; what it keeps for a character is one byte a tag."""

    def __init__(self, trans: np.ndarray):
        self.trans, self.score, self.back = trans, None, []

    def feed(self, emit: np.ndarray) -> None:
        back = np.zeros(emit.shape, np.uint8)
        for i, own in enumerate(emit):
            if self.score is None:
                self.score = own
                continue
            both = self.score[:, None] + self.trans
            back[i] = both.argmax(0)
            self.score = both.max(0) + own
        self.back.append(back)

    def finish(self) -> np.ndarray:
        back = np.concatenate(self.back)
        out = np.empty(len(back), np.int64)
        out[-1] = self.score.argmax()
        for i in range(len(back) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags of one stretch (time, tag)."""
    decoder = Viterbi(trans)
    decoder.feed(emit)
    return decoder.finish()


def spans_of(tags: np.ndarray, shift: int) -> list[tuple[str, int, int]]:
    out, start, kind = [], -1, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        inside = tag and tag % 2 == 0 and (tag - 1) // 2 == kind
        if kind >= 0 and not inside:
            out.append((KINDS[kind], shift + start, shift + i))
            kind = -1
        if tag and tag % 2 == 1:
            start, kind = i, (tag - 1) // 2
    return out


def _stretches(texts: list[str]):
    """(text, window starts) of each run of windows that overlap."""
    for i, text in enumerate(texts):
        starts = window_starts(text)
        at = 0
        for to in range(1, len(starts) + 1):
            if to == len(starts) or starts[to] - starts[to - 1] >= WINDOW:
                yield i, starts[at:to]
                at = to


def added_spans(tagger: Tagger, texts: list[str], ruled: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger adds to each text; every stretch is decoded as a whole, however long it is."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    waiting: list[tuple[int, list[int]]] = []
    held = 0
    for i, starts in _stretches(texts):
        waiting.append((i, starts))
        held += len(starts)
        if held >= BATCH:
            _tag(tagger, texts, ruled, waiting, out)
            waiting, held = [], 0
    _tag(tagger, texts, ruled, waiting, out)
    return out


def _tag(tagger, texts, ruled, stretches, out) -> None:
    """Score the windows of some stretches ``BATCH`` at once; a stretch's scores are averaged and decoded as they come."""
    places = [(n, s) for n, (_, starts) in enumerate(stretches) for s in starts]
    trans = tagger.w["trans"]
    n, pos = -1, 0
    decoder = total = count = None
    for at in range(0, len(places), BATCH):
        part = places[at : at + BATCH]
        codes = np.full((len(part), WINDOW), 4, np.int64)
        for row, (k, s) in enumerate(part):
            own = encode(texts[stretches[k][0]][s : s + WINDOW])
            codes[row, : len(own)] = own
        scores = tagger.scores(codes)
        for row, (k, s) in enumerate(part):
            i, starts = stretches[k]
            end = min(len(texts[i]), starts[-1] + WINDOW)
            if k != n:
                n, pos, decoder = k, starts[0], Viterbi(trans)
                total, count = np.zeros((0, TAGS)), np.zeros((0, 1))
            size = min(WINDOW, end - s)
            grow = s + size - pos - len(total)
            if grow > 0:
                total, count = np.concatenate([total, np.zeros((grow, TAGS))]), np.concatenate([count, np.zeros((grow, 1))])
            total[s - pos : s - pos + size] += scores[row, :size]
            count[s - pos : s - pos + size] += 1
            following = places[at + row + 1] if at + row + 1 < len(places) else None
            done = following[1] if following is not None and following[0] == k else end  # no later window reaches what lies before
            decoder.feed(total[: done - pos] / count[: done - pos])
            total, count, pos = total[done - pos :], count[done - pos :], done
            if done == end and (following is None or following[0] != k):
                _add(texts[i], starts[0], decoder.finish(), ruled[i], out[i])


def _add(text: str, begin: int, tags: np.ndarray, ruled: list[tuple[str, int, int]], out: list[tuple[str, int, int]]) -> None:
    for kind, s, e in spans_of(tags, begin):
        value = text[s:e]
        shaped = {"email": "@" in value[1:-1], "ip": value.count(".") == 3 and all(p.isdigit() for p in value.split(".")), "card": value[0].isdigit(), "phone": value[0] == "+"}[kind]
        free = all(k != kind or e <= x or s >= y for k, x, y in ruled) and all(k != kind or e <= x or s >= y for k, x, y in out)
        if shaped and value.isascii() and sound(kind, value) and free:
            out.append((kind, s, e))


def training_windows(docs: DataFrame, rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of windows of the ``rows`` documents of least hash; failed matches are not learned from."""
    ids = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(rows)
    texts = docs.select(F.xxhash64("doc_id").alias("h"), "text").join(F.broadcast(ids.distinct()), "h")

    def cut(batches):
        for batch in batches:
            parts, marks, order = [], [], []
            for text in batch.column("text").to_pylist():
                spans, failed = rule_spans(text)
                clear = [x for n, x in enumerate(spans) if not any(x[1] < y[2] and y[1] < x[2] for y in spans[:n])]
                for s in window_starts(text or ""):
                    part = text[s : s + WINDOW]
                    whole = all(y <= s or x >= s + WINDOW or (x >= s and y <= s + WINDOW) for _, x, y in clear)
                    if len(part) == WINDOW and whole and not any(x < s + WINDOW and y > s for x, y in failed):
                        own = [(k, x - s, y - s) for k, x, y in clear if s <= x and y <= s + WINDOW]
                        parts.append(part)
                        marks.append(tags_of(WINDOW, own).astype(np.uint8).tobytes())
                        order.append(hashlib.md5(part.encode()).hexdigest())
            yield pa.record_batch({"part": pa.array(parts, pa.string()), "tags": pa.array(marks, pa.binary()), "h": pa.array(order, pa.string())})

    found = texts.select("text").mapInArrow(cut, "part string, tags binary, h string").distinct().orderBy("h").limit(windows).collect()
    if not found:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    return np.stack([encode(r["part"]) for r in found]), np.stack([np.frombuffer(r["tags"], np.uint8) for r in found]).astype(np.int64)


def train(docs: DataFrame) -> Tagger | None:
    codes, tags = training_windows(docs)
    return Tagger().fit(codes, tags) if tags.any() else None


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_personal_data(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, base, added): spans of each document as texts, by the rules and those added."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ruled = [rule_spans(t)[0] for t in texts]
            added = added_spans(tagger, texts, ruled) if tagger else [[] for _ in texts]
            counts = {f"n_{k}": pa.array([sum(x[0] == k for x in r) for r in ruled], pa.int64()) for k in KINDS}
            bases = [joined(r) for r in ruled]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), **counts, "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in bases], pa.string()),
                "spans": pa.array([joined(r + a) for r, a in zip(ruled, added, strict=True)], pa.string()), "n_added": pa.array([len(a) for a in added], pa.int64())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
