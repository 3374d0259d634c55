"""Plain models of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring(rows, window=20):
    """rows: (doc_id, text) in any order -> {doc_id: (n_words, n_removed, sha)}"""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, found = {}, {}
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    for d, (i, w) in enumerate(docs):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (d, p))
    for d, (i, w) in enumerate(docs):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (d, p):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        found[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return found


def suffix(rows, length=400):
    """rows: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    docs = [(i, (t or "").encode()) for i, t in rows]
    count, found = {}, {}
    for _, b in docs:
        for p in range(len(b) - length + 1):
            k = hash(b[p : p + length])
            count[k] = count.get(k, 0) + 1
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[hash(b[p : p + length])] > 1:
                gone[p : p + length] = b"\x01" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        found[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return found


def jaccard(rows, size=5, percent=75):
    """rows: (doc_id, text) -> {doc_id: (set size, smallest linked id)}"""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), None if i is None else root(i)) for i, s in sets.items()}


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[p : p + 3]) for p in range(len(w) - 2)]
    hit = {p + o for p, x in enumerate(windows) if windows.count(x) > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def with_repeats(doc_id, text):
    """The words of a text, for every tenth id by checksum with a period planted."""
    w = WORD.findall(text or "")
    if doc_id is None or not w:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def runs(w, least=12):
    """All (start, length, period) of maximal stretches by comparing words at every offset."""
    code = {}
    t, found = np.array([code.setdefault(x, len(code)) for x in w], np.int64), {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate(([False], t[q:] == t[:-q], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= q and e - s + q >= least:
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periods(rows):
    """rows: (doc_id, text) -> result rows of the registered query"""
    out = []
    for i, t in rows:
        w = with_repeats(i, t)
        r = runs(w)
        gone = {k for s, n, q in r for k in range(s + q, s + n)}
        best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(r, key=lambda x: (x[0], x[2])))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((i, len(r), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept)))
    return out


def resample(rows, target, percent=10, least=20, buckets=10000, most=1, seed=2024):
    """rows: (doc_id, text), target: texts -> result rows (doc_id, n_features, weight, score, rank)"""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for count, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                count[b] += 1
    gain = [math.floor(1000 * math.log((y + 1.0) * (sum(s) + buckets) / ((x + 1.0) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, x in rows:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((n, i, len(f), weight, score))
    drawn = sorted((r for r in out if r[1] is not None and r[0] >= least), key=lambda r: (-r[4], r[1], r[2], r[3]))
    k = percent * len(drawn) // 100
    ranked = [(*r[1:], at + 1 if at < k else None) for at, r in enumerate(drawn)]
    return ranked + [(*r[1:], None) for r in out if r[1] is None or r[0] < least]


class KneserNey:
    """Interpolated modified Kneser-Ney over lists of words, by dictionaries; ``log10_prob`` of a text with its end mark."""

    def __init__(self, texts):
        self.c3 = Counter(g for t in texts for g in self.trigrams(t))
        self.c2 = Counter((v, w) for _, v, w in self.c3)
        self.c1 = Counter(w for _, w in self.c2)
        self.d = [self._discounts(c.values()) for c in (self.c1, self.c2, self.c3)]
        self.sums = {}
        for order, counts in ((3, self.c3), (2, self.c2)):
            for gram, c in counts.items():
                total, taken = self.sums.get(gram[:-1], (0, 0.0))
                self.sums[gram[:-1]] = total + c, taken + self._less(c, order)

    @staticmethod
    def trigrams(text):
        before = ["<", "<", *text]
        return list(zip(before, before[1:], [*text, None]))

    @staticmethod
    def _discounts(counts):
        n = [max(1, sum(c == i for c in counts)) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) for i in range(3)]

    def _less(self, c, order):
        return self.d[order - 1][min(c, 3) - 1]

    def p1(self, w):
        n, taken = sum(self.c1.values()), sum(self._less(c, 1) for c in self.c1.values())
        own = self.c1[w] - self._less(self.c1[w], 1) if w in self.c1 else 0
        return own / n + taken / n / (len(self.c1) + 1)

    def p(self, u, v, w):
        out = self.p1(w)
        for order, counts, gram in ((2, self.c2, (v, w)), (3, self.c3, (u, v, w))):
            if gram[:-1] in self.sums:
                total, taken = self.sums[gram[:-1]]
                own = counts[gram] - self._less(counts[gram], order) if gram in counts else 0
                out = own / total + taken / total * out
        return out

    def log10_prob(self, text):
        return sum(math.log10(self.p(*g)) for g in self.trigrams(text))
