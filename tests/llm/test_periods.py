"""Periodic runs against comparison at every offset."""

import random

import brute
import numpy as np
from test_operators import awkward, frame, same

from veilink.llm import periods, registry

SMALL = "/root/testdata/sf0.001"


def found(texts, least=12):
    groups = periods._group([[x.encode() for x in t] for t in texts], least)
    return [[(r["start"], r["length"], r["period"]) for r in runs] for runs, _ in groups]


def periodic(rng):
    """Words of a small alphabet with nested powers, shifted copies and breaks."""
    def power(depth):
        if not depth:
            return [rng.choice("abc") for _ in range(rng.randrange(1, 4))]
        base = power(depth - 1)
        out = base * rng.choice([1, 2, 3, rng.randrange(2, 30)])
        return out + base[: rng.randrange(len(base) + 1)] + ([rng.choice("abcd")] if rng.random() < 0.4 else [])
    out = []
    while len(out) < 10:
        out += power(rng.randrange(4))[:900]
    if rng.random() < 0.6:
        out = out + out[: rng.randrange(len(out) + 1)]
    return out[:3000]


def test_nested_powers():
    rng = random.Random(11)
    texts = [periodic(rng) for _ in range(1500)]
    for at in range(0, 1500, 50):
        group = texts[at : at + 50]
        for text, got in zip(group, found(group), strict=True):
            assert got == brute.runs(text), " ".join(text)


def test_short_runs_too():
    """Without a least length all runs come out, of any exponent from two."""
    rng = random.Random(12)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(0, 120))] for _ in range(800)]
    for text, got in zip(texts, found(texts, 2), strict=True):
        assert got == brute.runs(text, 2), "".join(text)


def test_known_families():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    long = ["ab" * 50 + "a" + "ab" * 50 + "a", "a" * 100 + "b" + "a" * 100 + "b" + "a" * 100, ("a" * 50 + "b") * 3, ("ab" * 40 + "a") * 5, "abc" * 400]
    long += [("a" * 30 + "b" * 30) * 3 + "a" * 31, fibonacci[-1], "".join(f"{i:b}" for i in range(400))]
    long += [("ab" * 40 + "a") * 4 + "b" + ("ab" * 40 + "a") * 4, ("a" * 90 + "b") * 2 + ("a" * 90 + "c") * 2 + ("a" * 90 + "b") * 2]
    texts = [list(x) for x in long]
    for text, got in zip(texts, found(texts), strict=True):
        assert got == brute.runs(text)


def test_runs_stay_in_their_document():
    texts = [list("ab" * 5), list("ab" * 5), list("ab" * 6), [], list("xyzxyz")]
    assert found(texts) == [[], [], [(0, 12, 2)], [], []]


def test_synchronising_positions_are_consistent_and_dense():
    """Equal contexts are chosen alike, and every stretch of t places has one unless its surroundings are periodic."""
    rng = np.random.default_rng(5)
    t = 8
    seq = np.concatenate((rng.integers(0, 3, 4000), np.tile([1, 2], 60), rng.integers(0, 3, 4000)))
    runs = periods.runs_of(np.append(seq, -1), np.array([0, len(seq) + 1]))
    names = periods.words.chain(periods.words.mix(seq.astype(np.uint64) + np.uint64(9)), t)
    chosen = set(periods._synchronising(names, t, runs).tolist())
    seen = {}
    for i in range(len(seq) - 2 * t + 1):
        assert seen.setdefault(tuple(seq[i : i + 2 * t]), i in chosen) == (i in chosen)
    for i in range(0, len(seq) - 3 * t + 2):
        part = seq[i : i + 3 * t - 1]
        periodic = any((part[q:] == part[:-q]).all() for q in range(1, t // 3 + 1))
        assert periodic == (not any(i + k in chosen for k in range(t)))


def test_table_with_nulls_and_repeats(spark):
    rng = random.Random(13)
    rows = awkward() + [(1000 + i, " ".join(periodic(rng))) for i in range(60)] + [(None, "a b " * 8), (7, "z " * 40), (7, "z " * 40), (8, "a\xa0b \x1c a\xa0b \x1c " * 9)]
    docs = frame(spark, rows)
    got = [tuple(r) for r in periods.digests(periods.periodic_runs(periods.with_repeats(docs))).collect()]
    same(got, brute.periods(rows))
    assert periods.periodic_runs(docs.where("doc_id < 0")).count() == 0


def test_longest_run_and_collapsed_text(spark):
    docs = frame(spark, [(1, "x y " + "a b c " * 5 + "d"), (2, "no runs here")])
    got = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert got[1].runs[0].asDict() == {"start": 2, "length": 15, "period": 3}
    assert got[1].collapsed == "x y a b c d" and got[2].collapsed == "no runs here" and got[2].runs == []


def test_registered(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in registry.op12_periodic_runs(spark, SMALL).collect()]
    same(got, brute.periods(rows))
    assert sum(1 for r in got if r[1]) >= 15
