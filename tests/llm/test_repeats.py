import hashlib
import random

import pytest

import brute
from veilink.llm import registry, substring, suffix

SMALL = "/root/testdata/sf0.001"


def awkward(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd éé x　y zz Q q".split(" "))
    passage = " ".join(str(rng.random()) for _ in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, passage), (70, passage + " tail"), (5, "head\x0b" + passage)]
    rows += [(i, passage[: 40 * i] + "".join(rng.choice([" ", "\n", "\x0c "]) + word() for _ in range(80))) for i in range(10, 18)]
    rows += [(30, "a " * 900), (31, "a " * 300), (32, "é" * 500), (33, "ab" * 450), (34, passage * 3), (35, "k" * 399), (36, "k" * 400)]
    rows += [(99, "long " + " ".join(str(rng.random()) for _ in range(30000)))]
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    return [docs, awkward(1), []]


def frame(spark, rows):
    data = [(t, i, 5, "x") for i, t in rows]
    return spark.createDataFrame(data, "text string, doc_id long, chunk int, alive string").repartition(3)


@pytest.mark.parametrize("which", [0, 1, 2])
def test_substring_equals_brute_force(spark, tables, which):
    rows = tables[which]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute.substring(rows)


@pytest.mark.parametrize("which", [0, 1, 2])
def test_suffix_equals_brute_force(spark, tables, which):
    rows = tables[which]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute.suffix(rows)


@pytest.mark.parametrize("window,start", [(5, 5), (7, 2), (12, 3)])
def test_substring_lengths(spark, window, start):
    rows = awkward(2)
    got = substring.remove_repeats(frame(spark, rows), window=window, start=start, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring(rows, window)
    assert all(hashlib.sha256(b" ".join(r.kept.encode().split())).hexdigest() == r.kept_sha256 for r in got)
    texts = dict(rows)
    assert all(r.kept == (texts[r.doc_id] or "") for r in got if not r.n_removed)


def test_registered_repeats(spark, tables):
    got = {r.doc_id: r.kept_sha256 for r in registry.op6_substring_dedup(spark, SMALL).collect()}
    assert got == {i: v[2] for i, v in brute.substring(tables[0]).items()}
    got = {r.doc_id: r.kept_sha256 for r in registry.op9_suffix_dedup(spark, SMALL).collect()}
    assert got == {i: v[3] for i, v in brute.suffix(tables[0]).items()}
