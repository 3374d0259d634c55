"""Small single-process models the operators are compared with; written from the operators' definitions."""

import hashlib


def bigrams(value):
    padded = f"_{value}_"
    return [padded[i : i + 2] for i in range(len(padded) - 1)]


def positions(token, k, size, family, mode="literal"):
    h1, h2, h3 = (int.from_bytes(h(token.encode()).digest(), "big") for h in (hashlib.md5, hashlib.sha256, hashlib.sha512))
    found = []
    for c in range(1, k + 1):
        extra = 0
        if family == "TripleHash":
            extra = c * (c - 1) // 2 * h3
        elif family == "EnhancedDHash":
            extra = int((c ^ (3 - c)) / 6) if mode == "literal" else (c**3 - c) // 6
        found.append((h1 + c * h2 + extra) % size)
    return found


def attribute_filter(values, m, k, family):
    return {
        i * m + p
        for i, v in enumerate(values)
        if v is not None
        for t in bigrams(v)
        for p in positions(t, k, m, family)
    }


def shared_filter(values, size, k, family):
    return {p for v in values if v is not None for t in bigrams(v) for p in positions(t, k, size, family)}


def split_bit(rows):
    """Bit with the most even split over (id, set) rows, lowest first; None if all rows are equal."""
    n = len(rows)
    counts = {}
    for _, bits in rows:
        for b in bits:
            counts[b] = counts.get(b, 0) + 1
    usable = [(abs(2 * c - n), b) for b, c in counts.items() if c < n]
    return min(usable)[1] if usable else None


def leaves(rows, group=5, path="", root=True):
    """Leaf path of every id."""
    bit = split_bit(rows) if root or len(rows) > group else None
    if bit is None:
        return {i: path for i, _ in rows}
    found = {}
    for turn in "01":
        side = [r for r in rows if (bit in r[1]) == (turn == "1")]
        found |= leaves(side, group, path + turn, False)
    return found


def walk(bits, rows, group=5, path="", root=True):
    """Leaf path another filter ends in."""
    bit = split_bit(rows) if root or len(rows) > group else None
    if bit is None:
        return path
    turn = bit in bits
    side = [r for r in rows if (bit in r[1]) == turn]
    return walk(bits, side, group, path + "01"[turn], False)


def dice(x, y):
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else None


def best(bits, rows):
    """(id, dice) of the first best row, or (None, None)."""
    top = (None, None)
    for i, other in sorted(rows):
        d = dice(bits, other)
        if d and (top[1] is None or d > top[1]):
            top = (i, d)
    return top


def to_words(bits, words):
    packed = [0] * words
    for b in bits:
        packed[b // 64] |= 1 << (b % 64)
    return [w - (1 << 64) if w >> 63 else w for w in packed]
