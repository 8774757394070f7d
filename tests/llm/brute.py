"""Plain-Python versions of the operators that SQL can't express."""

from __future__ import annotations

import hashlib
import math
import re

import xxhash


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints, ids, budget=4):
    """Smallest id (None last) reachable from each row."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(prints))]


def removed_bytes(rows, length=50):
    """(id, n_bytes, n_removed, n_spans, kept hash); null ids first."""
    seen, out = {}, []
    order = lambda i: (i is not None, i or 0)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in sorted(texts, key=lambda r: order(r[0])):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a:a + length], order(i))
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a:a + length]] < order(i):
                gone[a:a + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed_words(rows, window=20):
    """(id, n_words, n_removed, kept hash); null ids first, then by text."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a:a + window])
            if key in seen:
                gone[a:a + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


#: The contract's base patterns as written there; kind, pattern, group, least length.
BASE = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]


def base_spans(text):
    found = []
    for place, (kind, pattern, group, least) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), place, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def edited(rows):
    """id -> (text, edited text, next id) for distinct ids."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt, other = rows[(k + 1) % len(rows)]
        n = len(t) // 4
        out[i] = (t, t[:len(t) - n] + other[:n], nxt)
    return out


class KneserNey:
    """Interpolated Kneser-Ney over characters, with dictionaries of strings."""

    def __init__(self, texts, order, alphabet):
        self.order, self.alphabet = order, alphabet
        counts, kinds = {}, [set() for _ in range(order + 1)]
        for text in texts:
            line = self.line(text)
            for i in range(order - 1, len(line)):
                gram = line[i - order + 1:i + 1]
                counts[gram] = counts.get(gram, 0) + 1
                for n in range(1, order + 1):
                    kinds[n].add(gram[order - n:])
        self.counts = [None] * order + [counts]
        for n in range(1, order):
            lower = self.counts[n] = {}
            for gram in kinds[n + 1]:
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
        self.discount, self.mass, self.followers = [None], [None], [None]
        for n in range(1, order + 1):
            values = list(self.counts[n].values())
            ones, twos = values.count(1), values.count(2)
            self.discount.append(ones / (ones + 2 * twos) if ones and twos else 0.5)
            mass, followers = {}, {}
            for gram, c in self.counts[n].items():
                mass[gram[:-1]] = mass.get(gram[:-1], 0) + c
                followers[gram[:-1]] = followers.get(gram[:-1], 0) + 1
            self.mass.append(mass)
            self.followers.append(followers)

    def line(self, text):
        """Letters in lower case, runs of anything else as one blank, padded before the first character."""
        clean = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip(" ")
        return " " * (self.order - 1) + clean + " " if clean else ""

    def p(self, gram):
        n, context = len(gram), gram[:-1]
        lower = self.p(gram[1:]) if n > 1 else 1 / self.alphabet
        if context not in self.mass[n]:
            return lower
        d, mass = self.discount[n], self.mass[n][context]
        return max(self.counts[n].get(gram, 0) - d, 0) / mass + d * self.followers[n][context] / mass * lower

    def cross_entropy(self, text):
        line = self.line(text)
        return -sum(math.log(self.p(line[i - self.order + 1:i + 1])) for i in range(self.order - 1, len(line))) / (
            len(line) - self.order + 1)
