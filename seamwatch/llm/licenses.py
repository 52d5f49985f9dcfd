"""License scans by patience alignment.

A template's rare words vote, by their place in it, for where a copy may start in a text.  Each
cluster of votes gives a region that is aligned with the template.  Smaller clusters outside of
hits are chained as long as their template places rise, however far apart they are; such a region
is the pieces and the words next to them, so that a page break, an inserted clause or a missing
one hides no copy, and words of a wide gap do not count as matched.  A piece has four votes at
least: a notice of a few words is one piece.  In an alignment words unique to both sides are
anchors, their longest increasing subsequence is kept, and the gaps between anchors are aligned
the same way (equal words at a gap's two ends are matched first).  Coverage is the matched share
of the template's words; regions from ``COVERAGE`` on are hits, and of overlapping hits of one
template the best, then the first, stays.  Licenses of one family differ by few words (CC BY and
CC BY-NC, GPL 2 and 3): of overlapping hits of templates that are themselves alike the one of the
greatest coverage, then of the most words, stays; a header inside a whole text is a hit of its own.

Words are runs of letters and digits, lower-cased.  Null and empty texts have no hit; whole texts
are scanned, and a notice that repeats is a hit each time.  Repeated rows are scanned each.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8
#: Words by which a copy may be longer or shorter than the template before its rare words.
SLACK = 12
#: Votes of a piece that may be joined to others over a gap of any length, and what a gap costs a chain.
PIECE, JUMP = 4, 2
#: Words from which on a template is long, and the share of its words that vote then: more than a hit may lack.
LONG, VOTERS = 400, 0.4
#: Words of templates too common to vote.
COMMON = frozenset("a all and any are as at be by for in is it may not of on or that the this to under with you your work use without".split())

_GNU = ("{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} General Public License as published by "
        "the Free Software Foundation{3} {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} General Public License for more details.")
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
       "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}


def _published() -> dict[str, str]:
    """The whole texts in ``license_texts``, each as its owner publishes it but for lines of copyright holders."""
    folder = resources.files("seamwatch.llm").joinpath("license_texts")
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def _gnu_headers() -> dict[str, str]:
    out = {}
    for name, title, kind, version in (("gpl", "This program", "", "2"), ("gpl", "This program", "", "3"), ("lgpl", "This library", "Lesser", "2.1"),
                                       ("lgpl", "This library", "Lesser", "3"), ("agpl", "This program", "Affero", "3")):
        own = version if "." in version else version + ".0"
        mark, first = (";", ";") if version in ("2", "2.1") else (":", ",")
        out[f"{name}-{own}-or-later-header"] = _GNU.format(title, mark, kind, f"{first} either version {version} of the License, or (at your option) any later version.")
        out[f"{name}-{own}-only-header"] = _GNU.format(title, mark, kind, f", version {version}." if first == "," else f"; version {version} of the License.")
    return out


def _cc_notices() -> dict[str, str]:
    out = {}
    for version, scope in (("4.0", "International"), ("3.0", "Unported")):
        for code, title in _CC.items():
            title = title.replace("Derivatives", "Derivs") if version == "3.0" else title
            out[f"cc-{code}-{version}"] = f"Licensed under CC {code.upper()} {version}."
            out[f"cc-{code}-{version}-notice"] = f"This work is licensed under a Creative Commons {title} {version} {scope} License."
    return out


# Short notices and standard headers, beside the whole published texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied."),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software"),
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "rights-reserved": "All rights reserved.",
    "bsd": "Released under the BSD License.",
    "isc": "Released under the ISC License.",
    "mpl-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "cc0-1.0": "Licensed under CC0 1.0 Universal.",
    **_cc_notices(),
    **_gnu_headers(),
    **_published(),
}

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _unique(tokens: list[str], lo: int, hi: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i in range(lo, hi):
        seen[tokens[i]] = -1 if tokens[i] in seen else i
    return {t: i for t, i in seen.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, that also rises in the second (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
        back.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text, template) places, rising in both."""
    found: list[tuple[int, int]] = []
    open_ = [(0, len(text), 0, len(template))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = _unique(text, a, b), _unique(template, c, d)
        anchors = _increasing(sorted((i, theirs[t]) for t, i in ours.items() if t in theirs))
        if not anchors:
            continue
        found.extend(anchors)
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        open_.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False))
    return sorted(found)


def _voters(tokens: list[str]) -> set[str]:
    """The words that vote: all rare ones, of long templates the rarest that make up ``VOTERS`` of its words."""
    counts = Counter(t for t in tokens if t not in COMMON)
    if len(tokens) <= LONG:
        return set(counts)
    out, held = set(), 0
    for t, n in sorted(counts.items(), key=lambda c: (c[1], c[0])):
        if held >= VOTERS * len(tokens):
            break
        out.add(t)
        held += n
    return out


class Scanner:
    """Templates ready for scanning."""

    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {name: [w for w, _, _ in words(t)] for name, t in templates.items()}
        self.counts = {name: Counter(tokens) for name, tokens in self.templates.items()}
        self.rare = {name: _voters(tokens) for name, tokens in self.templates.items()}
        self.votes: dict[str, list[tuple[str, int]]] = {}
        for name, tokens in self.templates.items():
            for i, t in enumerate(tokens):
                if t in self.rare[name]:
                    self.votes.setdefault(t, []).append((name, i))
        self.names = list(self.templates)
        self.place = {w: i for i, w in enumerate(dict.fromkeys(w for t in self.templates.values() for w in t))}
        self.uses = np.zeros((len(self.place), len(self.names)), np.int32)
        for k, counts in enumerate(self.counts.values()):
            for w, n in counts.items():
                self.uses[self.place[w], k] = n
        self.least = np.array([coverage * len(t) - 1e-9 for t in self.templates.values()])
        self.alike: dict[tuple[str, str], bool] = {}

    def _possible(self, text: str) -> set[str]:
        """Templates of which the text has enough words at all, in whatever order."""
        there = {w.lower() for w in set(_WORD.findall(text))}
        known = [self.place[w] for w in there & self.place.keys()]
        return {self.names[k] for k in np.flatnonzero(self.uses[known].sum(axis=0) >= self.least)} if known else set()

    def _related(self, a: str, b: str) -> bool:
        """Whether two templates are much the same words: one is at most twice the other and holds nearly all of it."""
        key = (min(a, b), max(a, b))
        if key not in self.alike:
            m, n = len(self.templates[a]), len(self.templates[b])
            self.alike[key] = max(m, n) <= 2 * min(m, n) and sum((self.counts[a] & self.counts[b]).values()) >= self.coverage * min(m, n) - 1e-9
        return self.alike[key]

    def _best_of_family(self, hits: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
        kept, group, end = [], [], -1
        for hit in [*sorted(hits, key=lambda h: (h[2], h[3], h[0])), None]:
            if hit is None or hit[2] >= end:
                stay: list[tuple[str, float, int, int]] = []
                for h in sorted(group, key=lambda h: (-h[1], -len(self.templates[h[0]]), h[2], h[0])):
                    if all(h[3] <= k[2] or h[2] >= k[3] or h[0] == k[0] or not self._related(h[0], k[0]) for k in stay):
                        stay.append(h)
                kept.extend(stay)
                group = []
            if hit is not None:
                group.append(hit)
                end = max(end, hit[3])
        return kept

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of all hits, places in code points."""
        if not text:
            return []
        names = self._possible(text)
        if not names:
            return []
        found = words(text)
        tokens = [w for w, _, _ in found]
        there = Counter(tokens)
        names = {n for n in names if sum(min(k, there[w]) for w, k in self.counts[n].items()) >= self.coverage * len(self.templates[n]) - 1e-9}
        starts: dict[str, list[tuple[int, int]]] = {}
        for at, token in enumerate(tokens):
            for name, i in self.votes.get(token, ()):
                if name in names:
                    starts.setdefault(name, []).append((at - i, at))
        hits = []
        for name, votes in starts.items():
            hits.extend(self._best(name, tokens, found, sorted(votes)))
        return sorted(self._best_of_family(hits), key=lambda h: (h[2], h[0]))

    def _best(self, name, tokens, found, votes):
        template = self.templates[name]
        missing = (1 - self.coverage) * len(template) + 1e-9
        enough = max(1, math.ceil(sum(t in self.rare[name] for t in template) - missing))
        kept = self._close(tokens, template, [d for d, _ in votes], missing, enough)
        kept = self._joined(tokens, template, votes, kept, missing, enough)
        return [(name, -size / len(template), found[first][1], found[last][2]) for first, size, last in kept]

    def _close(self, tokens, template, votes, missing, enough):
        """Hits with nearly all their votes within ``SLACK`` words of one start: (first, -matched, last)."""
        reach = min(SLACK, len(template))
        hits, to = set(), 0
        for at, vote in enumerate(votes):
            if at and vote == votes[at - 1]:
                continue
            while to < len(votes) and votes[to] - vote <= reach:
                to += 1
            if to - at < enough:
                continue
            low, high = max(0, vote), vote + len(template)
            matched = align(tokens[low:high], template)
            if len(matched) < len(template):  # no plain copy: allow for words more or less on either side
                low, high = max(0, vote - reach), min(len(tokens), votes[to - 1] + len(template) + reach)
                matched = align(tokens[low:high], template)
            if len(matched) >= len(template) - missing:
                hits.add((low + matched[0][0], -len(matched), low + matched[-1][0]))
        kept, group, end = [], [], -1
        for hit in [*sorted(hits), (len(tokens), 0, len(tokens))]:
            if hit[0] > end:
                kept.extend(_apart(group))
                group = []
            group.append(hit)
            end = max(end, hit[2])
        return kept

    def _joined(self, tokens, template, votes, kept, missing, enough):
        """The hits, and those whose pieces are further apart: pieces outside of hits, or those that complete one, are chained over gaps of any length."""
        taken = bytearray(len(tokens))
        for hit in kept:
            taken[hit[0] : hit[2] + 1] = b"\1" * (hit[2] + 1 - hit[0])
        pieces = _pieces([v for v in votes if not taken[v[1]]])
        if not pieces:
            return kept
        kept = set(kept)
        owner = {}
        for hit in kept:
            if -hit[1] < len(template):
                inside = [v for v in votes if hit[0] <= v[1] <= hit[2]]
                owner.update((p, hit) for p in _pieces(inside))
        while any(p not in owner for p in pieces):
            done = set()
            for chain in _chains([*pieces, *(p for p, h in owner.items() if h in kept)]):
                weight = Counter()
                for p in chain:
                    if p in owner:
                        weight[owner[p]] += p[4]
                own = max(weight, key=weight.get) if weight else None
                chain = [p for p in chain if p not in owner or owner[p] == own]
                free = [p for p in chain if p not in owner]
                if len(chain) < 2 or not free or 2 * sum(p[4] for p in chain) < enough:
                    continue
                if own is not None:
                    taken[own[0] : own[2] + 1] = bytes(own[2] + 1 - own[0])
                at = _around(chain, len(template), taken)
                matched = align([tokens[i] for i in at], template)
                if len(matched) >= len(template) - missing and (own is None or len(matched) > -own[1]):
                    kept.discard(own)
                    kept.add((at[matched[0][0]], -len(matched), at[matched[-1][0]]))
                    for i, _ in matched:
                        taken[at[i]] = 1
                    done.update(free)
                elif own is not None:
                    taken[own[0] : own[2] + 1] = b"\1" * (own[2] + 1 - own[0])
            if not done:
                break
            pieces = [p for p in pieces if p not in done]
        return sorted(kept)


def _pieces(votes: list[tuple[int, int]]) -> list[tuple]:
    """Runs of ``PIECE`` votes at least for one start, at most ``SLACK`` words apart: (first, last, template first, template last, votes)."""
    out, run = [], []
    for vote in [*sorted(votes), None]:
        if run and (vote is None or vote[0] != run[-1][0] or vote[1] - run[-1][1] > SLACK):
            if len(run) >= PIECE:
                (d, first), (_, last) = run[0], run[-1]
                out.append((first, last, first - d, last - d, len(run)))
            run = []
        run.append(vote)
    return out


def _chains(pieces: list[tuple]) -> list[list[tuple]]:
    """Disjoint chains of pieces that rise in the text and the template, those of most votes first; of equal ones the nearest are joined."""
    size = max(p[3] for p in pieces) + 2
    tree: list[tuple[int, int]] = [(0, -1)] * (size + 1)  # best (score, piece) that ends up to a template place
    order = sorted(range(len(pieces)), key=lambda i: pieces[i][:2])
    ends = sorted(order, key=lambda i: pieces[i][1])
    score, back, at = [0] * len(pieces), [-1] * len(pieces), 0
    ranks = {i: r for r, i in enumerate(ends)}
    for j in order:
        while at < len(ends) and pieces[ends[at]][1] < pieces[j][0]:
            i, k = ends[at], pieces[ends[at]][3] + 1
            while k <= size:
                tree[k] = max(tree[k], (score[i], ranks[i]))
                k += k & -k
            at += 1
        best, k = (0, -1), pieces[j][2]  # template places before the first
        while k > 0:
            best = max(best, tree[k])
            k -= k & -k
        score[j], back[j] = pieces[j][4], -1
        if best[0] > JUMP:
            score[j], back[j] = pieces[j][4] + best[0] - JUMP, ends[best[1]]
    out, used = [], [False] * len(pieces)
    for j in sorted(order, key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(pieces[j])
            j = back[j]
        if chain:
            out.append(chain[::-1])
    return out


def _around(chain: list[tuple], length: int, taken: bytearray) -> list[int]:
    """Free text places in the pieces and, on either side, of as many words as the template has there and ``SLACK`` more."""
    at: list[int] = []
    before, low = -1, 0
    for n, (first, last, c, d, _) in enumerate(chain):
        after = chain[n + 1][2] if n + 1 < len(chain) else length
        start = max(low, first - (c - before - 1) - SLACK)
        low = min(len(taken), last + (after - d - 1) + SLACK + 1)
        if n + 1 < len(chain):
            low = min(low, chain[n + 1][0])
        at.extend(i for i in range(start, low) if not taken[i])
        before = d
    return at


def _apart(group: list[tuple]) -> list[tuple]:
    """Of hits that overlap in a chain, the best that do not overlap each other."""
    kept: list[tuple] = []
    for hit in sorted(group, key=lambda h: (h[1], h[2] - h[0], h[0])):
        if all(hit[2] < k[0] or hit[0] > k[2] for k in kept):
            kept.append(hit)
    return sorted(kept)


@lru_cache(maxsize=2)
def _scanner(templates: tuple[tuple[str, str], ...], coverage: float) -> Scanner:
    return Scanner(dict(templates), coverage)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start, end), one row for each hit."""
    texts = tuple(templates.items())

    def run(batches):
        scanner = _scanner(texts, coverage)
        for batch in batches:
            hits = [(i, *h) for i, t in enumerate(batch.column("text")) for h in scanner.scan(t.as_py())]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())), "license": pa.array([h[1] for h in hits], pa.string()),
                "coverage": pa.array([h[2] for h in hits], pa.float64()), "start": pa.array([h[3] for h in hits], pa.int64()), "end": pa.array([h[4] for h in hits], pa.int64())})

    own = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return own.mapInArrow(run, "doc_id long, license string, coverage double, start long, end long")
