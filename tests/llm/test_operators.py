"""Each operator against a plain model, and on nulls, empty texts, ties, repeated rows and empty tables."""

import ctypes
import math
import random
import re
import zlib
from pathlib import Path

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilink.llm import bilinear, chunks, components, jaccard, kneser, mixing, packing, registry, rules, topk, urls
from veilink.sources.store import store

SMALL = "/root/testdata/sf0.001"
SCHEMA = "text string, doc_id long, source string, lang string, n_chars long, chunk int, size int, _row string, word string"


def frame(spark, rows):
    """(doc_id, text[, source]) rows in a table with columns that clash with the operators' own."""
    data = [(r[1], r[0], r[2] if len(r) > 2 else "s", "en", 0, 1, 2, "a", "b") for r in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def awkward(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "the", "É", "$$$", "a|b", "x!"]
    text = lambda k: "".join(rng.choice([" ", "\n", "  "]) + rng.choice(words) for _ in range(k))
    rows = [(i, text(rng.choice([1, 3, 4, 5, 6, 30, 60, 120]))) for i in range(n)]
    base = text(100).split()
    for i in range(n, n + 30):  # near copies
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "a b c d"), (206, "a b c d e"), (207, text(20000))]
    rows += [(i, "same text every time and again so it goes") for i in range(210, 230)] + [(None, "same text every time and again so it goes")]
    return rows


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def same(got, want):
    assert len(got) == len(want)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- similarity classes


@pytest.mark.parametrize("percent", [75, 90])
def test_similarity_classes(spark, percent):
    rows = awkward()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(frame(spark, rows), percent=percent).collect()}
    assert got == brute.jaccard(rows, percent=percent)


def test_similarity_classes_registered(spark, small):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op2_ngram_jaccard(spark, SMALL).collect()}
    assert got == brute.jaccard([r[:2] for r in small])


def test_bridged_classes(spark):
    """A chain of documents, each like the next only, among documents that share a long passage."""
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(12)]
    rows += [(100 + i, " ".join([f"u{i}x{j}" for j in range(40)] + words[200:260])) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(frame(spark, rows)).collect()}
    assert got == brute.jaccard(rows)
    assert got[11][1] == 0


def test_repeated_id_keeps_the_links_of_all_its_texts(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(3, text("a")), (7, text("a")), (7, text("b") + " more"), (9, text("b")), (11, text("c"))]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.similarity_classes(frame(spark, rows)).collect())
    assert got == [(3, 3), (7, 3), (7, 3), (9, 3), (11, 11)]


def test_shingles_travel_once(spark):
    """A table in buckets is joined without an exchange of its own, and leaves no name behind."""
    held = store(spark.range(200).withColumn("items", F.array("id")).repartition(3, "id"), "held", buckets=(3, "id"))
    assert held.rows == 200
    met = spark.range(100).withColumn("v", F.col("id") + 1).repartition(5).join(held.frame.hint("merge"), "id")
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r.v for r in met.collect()) == list(range(1, 101))
    held.drop()
    jaccard.similarity_classes(frame(spark, awkward(3, 60))).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("veilink_")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


# --- packing


def test_packing_round_trip(spark):
    rows = awkward() + [(300, "it's <|endoftext|> ½ 日本語 ΣΑΣ don't"), (300, "it's <|endoftext|> ½ 日本語 ΣΑΣ don't")]
    got = packing.pack(frame(spark, rows), group_documents=40).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    of_doc, of_sequence = {}, {}
    for r in got:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        of_doc.setdefault(r.doc_id, []).append(r)
        of_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        times = sum(1 for x in rows if x[0] == i)
        assert sum(r.length for r in of_doc[i]) == times * len(ids[i])
    for pieces in of_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_tournament_tree_is_first_fit():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 2049) for _ in range(700)), reverse=True)
    room, want = [], []
    for n in lengths:
        for b, left in enumerate(room):
            if left >= n:
                break
        else:
            b, _ = len(room), room.append(2048)
        want.append((b, 2048 - room[b]))
        room[b] -= n
    assert packing.first_fit_decreasing(lengths) == want


def test_little_padding(spark):
    got = registry.op1_packing(spark, SMALL).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in got) >= 0.9 * 2048 * len(got)


# --- rules


def test_rules(spark):
    rows = [(r[0], r[1]) for r in awkward() if r[0] != 207] + [(400, "a b c a b c x\nq\nq\n\n \nq"), (401, "a a a a a"), (402, "x y")]
    got = rules.ledger(frame(spark, rows)).collect()
    same(
        [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got],
        [(i, *brute.rules(t)) for i, t in rows],
    )


def test_policies_and_ablations(spark):
    marked = rules.ledger(frame(spark, awkward())).cache()
    names = rules.POLICIES[3]
    table = {r.rule: r for r in rules.ablations(marked, names).collect()}
    kept = rules.apply_policy(marked, names).where("kept").count()
    for name in names:
        fewer = rules.apply_policy(marked, [n for n in names if n != name]).where("kept").count()
        assert table[name].kept_without == fewer == kept + table[name].alone
        assert table[name].fails == rules.apply_policy(marked, [name]).where("NOT kept").count()
    v1 = rules.apply_policy(marked, rules.POLICIES[1]).where("kept").count()
    assert v1 >= kept


# --- URLs


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, a string, node string, rule int")


def test_url_rules(spark):
    rows = [
        (1, "http://X.Net/a", ""), (2, "http://example.net/en/x?y#z", None), (3, "https://a.example.com/de/", ""),
        (4, "http://b.org/fr/1", ""), (5, "http://b.org/fx", ""), (6, None, ""), (7, "mailto:x", ""), (8, "http://net?x", ""),
        (9, "http://notnet.com/", ""), (10, "http://x.net/p", ""), (10, "http://x.net/p", ""),
        (11, "http://good.com/a", '<LINK href="http://bad.net/q" rel="canonical">'),
        (12, "http://good.com/b", "<link rel=canonical href='/a'>"),
        (13, "http://c.com/1", '<meta http-equiv="refresh" content="0; url=http://d.com/2">'),
        (14, "http://d.com/2#top", ""), (15, "http://c.com/x/3", '<link rel="canonical" href="4">'),
        (16, "http://c.com/x/4", '<link rel="canonical" href="//h.org/fr/5">'), (17, "http://e.net/1", '<link rel="canonical" href="http://c.com/x/4">'),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages(spark, [(*r, "a", "n", 1) for r in rows])).collect()}
    assert got == {
        1: ("x.net", "/a", "net/", "block"), 2: ("example.net", "/en/x", "example.net/en/", "allow"),
        3: ("a.example.com", "/de/", "example.com/de/", "block"), 4: ("b.org", "/fr/1", "org/fr/", "allow"),
        5: ("b.org", "/fx", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("net", "", None, "allow"),
        9: ("notnet.com", "/", None, "allow"), 10: ("x.net", "/p", "net/", "block"),
        11: ("good.com", "/a", None, "block"), 12: ("good.com", "/b", None, "block"),
        13: ("c.com", "/1", None, "allow"), 14: ("d.com", "/2", None, "allow"),
        15: ("c.com", "/x/3", None, "allow"), 16: ("c.com", "/x/4", None, "allow"), 17: ("e.net", "/1", "net/", "block"),
    }
    extra = spark.createDataFrame([("http://c.com/1", "http://z.net/")], "from_url string, to_url string")
    moved = {r.page_id: r.verdict for r in urls.judge(pages(spark, [(*r, "a", "n", 1) for r in rows]), redirects=extra).collect()}
    assert moved[13] == "block" and moved[14] == "block" and moved[16] == "allow"


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_url_filters", "op7_source_mixing", "op10_exact_topk"])
def test_registered_equals_sql(spark, name):
    found = registry.all_queries()[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cursor = con.execute(registry.all_sql()[name])
    columns = [c[0] for c in cursor.description]
    same([tuple(r) for r in found.select(*columns).collect()], cursor.fetchall())


# --- mixing


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 50, 200]), rng.choice(["a", "b", "c", "é", None])) for i in range(600)]
    rows += [(None, "x y z", "a")] * 3 + [(1000, None, "a"), (1001, "only", "tiny")] + [(2000, "same same", "hot")] * 300
    frame_ = frame(spark, rows)
    got = mixing.plan(frame_).collect()
    assert len(got) == len(rows)
    total, sources = sum(r.size for r in got), {}
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        s = sources.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.taken
        s[3] = max(s[3], r.size)
    assert math.isclose(sum(s[1] for s in sources.values()), total)
    for size, target, taken, largest in sources.values():
        assert target <= 3 * size and abs(taken - target) <= largest + 1
    again = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.plan(frame_).collect())
    assert again == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    assert mixing.mixed(frame_).columns == frame_.columns
    assert mixing.mixed(frame_).count() == sum(r.copies for r in got)


def test_mix_does_not_depend_on_the_cells(spark, monkeypatch):
    """More digits of the hash make more cells and take the same documents; columns named like the line's own pass."""
    rows = [(i, "w " * (20 + i % 3), "ab"[i % 3 == 0]) for i in range(500)]
    docs = frame(spark, rows).withColumns({c: F.lit("mine") for c in ("_key", "_class", "_slice", "_hash", "_id", "_rank", "_before")})
    few = mixing.plan(docs).collect()
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)
    many = mixing.plan(docs).collect()
    assert sorted((r.doc_id, r.copies) for r in few) == sorted((r.doc_id, r.copies) for r in many)
    assert all(r._key == r._class == r._slice == r._hash == r._id == r._rank == r._before == "mine" for r in many)


def test_targets_are_refilled(spark):
    sizes = [("sa", 10), ("sb", 1000), ("sc", 1000), ("n", 5)]
    got = {r._key: r.target for r in mixing.targets(spark.createDataFrame(sizes, "_key string, source_size long")).collect()}
    assert got["sa"] == 30 and got["n"] == 15
    assert math.isclose(got["sb"] / 2, got["sc"] / 3) and math.isclose(sum(got.values()), 2015)


# --- models


def test_bilinear_base_and_split(spark):
    rows = [(i, t) for i, t in awkward() if i is not None]
    got = {r.doc_id: r for r in bilinear.score(frame(spark, rows)).collect()}
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tokens = {i: brute.WORD.findall((t or "").translate(lower)) + [None] for i, t in rows}
    counts, n = {}, 0
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            n += len(w)
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    for i, w in tokens.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
        want = sum(math.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (len(counts) + 1))) for x in w)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)


def test_bilinear_learns_order(spark):
    """Held-out text whose next word depends on the last one scores better than under word counts."""
    rng, words = random.Random(2), [f"t{i}" for i in range(40)]
    follow = {w: rng.sample(words, 3) for w in words}
    rows = []
    for i in range(1500):
        text = [rng.choice(words)]
        while len(text) < 60:
            text.append(rng.choice(follow[text[-1]]))
        rows.append((i, " ".join(text)))
    got = bilinear.score(frame(spark, rows), passes=2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]  # both negative


def test_bilinear_is_normalised():
    model = bilinear.Model.start(np.arange(1.0, 51.0))
    every = np.arange(50)
    for one, two in ((0, 0), (7, 3), (49, 1)):
        logs = model.log_prob(every, np.full(50, one), np.full(50, two))
        assert math.isclose(np.exp(logs).sum(), 1, abs_tol=1e-4)


def test_bilinear_without_words():
    model = bilinear.Model.start(np.array([3.0, 0.0]))
    logs = model.log_prob(np.array([0, 1]), np.array([0, 0]), np.array([0, 0]))
    assert math.isclose(np.exp(logs).sum(), 1, abs_tol=1e-4)


def test_bilinear_scores_do_not_depend_on_partitions(spark):
    """At the registered parameters: the same scores from one and from seven partitions, better than the base on held-out text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r for r in bilinear.score(docs.coalesce(1)).collect()}
    many = bilinear.score(docs.repartition(7)).collect()
    assert len(many) == len(one)
    assert all(math.isclose(r.score, one[r.doc_id].score, rel_tol=1e-6) for r in many)
    held = [r for r in many if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_bilinear_repeated_and_null_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "a b"), (None, "a b"), (2, None)]
    got = bilinear.score(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (0, 3), (1, 3), (1, 4), (1, 4), (2, 1)]
    assert len({r.score for r in got if r.doc_id == 1 and r.n_tokens == 4}) == 1


def test_kneser_ney_is_normalised(spark):
    rng, words = random.Random(4), [f"k{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(40)]
    model = kneser.fit(spark.createDataFrame([(t,) for t in texts], "t string"))
    name = lambda w: kneser._grams(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[2][0]
    known = {w for t in texts for w in t.split()}
    everything = np.array([name(w) for w in sorted(known)] + [kneser.LAST], np.uint64)
    for u, v in [("k1", "k2"), ("k3", "k3"), ("k5", "zzz"), ("yyy", "zzz")]:
        n = len(everything)
        p = 10 ** model.log10(np.full(n, name(u)), np.full(n, name(v)), everything)
        rest = 10 ** model.log10(np.array([name(u)]), np.array([name(v)]), np.array([12345], np.uint64))
        assert math.isclose(p.sum() + rest[0], 1, abs_tol=2e-3)


def test_kneser_ney_equals_a_plain_model(spark):
    """Probabilities of whole texts, of two models and one of words alone, fitted in one go."""
    rng, words = random.Random(18), [f"k{i}" for i in range(60)]
    text = lambda: rng.choices(words, [1 / (1 + j) for j in range(60)], k=rng.choice([0, 1, 2, 30, 200]))
    sets = [[text() for _ in range(n)] for n in (60, 9, 30)]
    rows = [(" ".join(t), m) for m, texts in enumerate(sets) for t in texts]
    models = kneser.fit_each(spark.createDataFrame(rows, "t string, m int").repartition(3), 3, words_only=1)
    plain = [brute.KneserNey(texts) for texts in sets]
    for t in [text() for _ in range(30)] + [["k1", "unknown", "k2", "k2"]]:
        line = " ".join(t).encode()
        u, v, w, _, _ = kneser._grams(np.frombuffer(line, np.uint8), np.array([0, len(line)]))
        for model, other in zip(models[:2], plain[:2], strict=True):
            assert math.isclose(model.log10(u, v, w).sum(), other.log10_prob(t), rel_tol=1e-6)
        alone = sum(math.log10(plain[2].p1(x)) for x in [*t, None])
        assert math.isclose(models[2].log10_word(w).sum(), alone, rel_tol=1e-6)


def test_contrasts_where_one_fold_has_rejected_text(spark):
    """The fold judged by a model of rejected text has contrasts, the other has none; both are judged by perplexity."""
    docs = spark.createDataFrame([(i, "good words all along " * 20 + f"n{i}", "en") for i in range(60)], "doc_id long, text string, lang string")
    sides = {r.doc_id: r.f for r in docs.select("doc_id", kneser.fold("doc_id").alias("f")).collect()}
    labels = spark.createDataFrame([(i, int(i < 50 or f == 1), int(i >= 50 and f == 0)) for i, f in sides.items()], "doc_id long, quality int, toxic int")
    got = kneser.judged(docs, labels).collect()
    assert len(got) == 60
    assert all((r.worst_words is None) == (sides[r.doc_id] == 0) for r in got)
    assert all(r.kept for r in got if sides[r.doc_id] == 0)


def test_classifier(spark):
    rng, words = random.Random(6), [f"g{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(400)]
    junk = [(1000 + i, " ".join(f"q{rng.random()}" for _ in range(40))) for i in range(20)]
    odd = [(2000, None), (2001, ""), (None, "g1 g2"), (2002, " ".join(rng.choices(words, k=20000)))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(5, 1, 0), (None, 1, 0), (1000, 0, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + junk + odd)
    got = {r.doc_id: r for r in kneser.judged(docs, labels, per_language=100).collect()}
    assert len(got) == 424
    assert all(not got[1000 + i].kept for i in range(20))
    assert sum(got[i].kept for i in range(400)) >= 396
    assert got[None].kept and got[2002].kept
    nothing = kneser.judged(docs, labels.where("doc_id < 0")).collect()
    assert len(nothing) == 424 and all(r.kept for r in nothing)


def test_classifier_on_columns_of_its_own_names(spark):
    rows = [(i, "good words " * 30, "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = docs.withColumns({c: F.lit("x") for c in ("_m", "m", "t", "i", "_text", "_n", "share")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    plain = {r.doc_id: (r.log10_prob, r.kept) for r in kneser.judged(docs, labels).collect()}
    assert plain == {r.doc_id: (r.log10_prob, r.kept) for r in kneser.judged(clash, labels, keep=["doc_id", "_m", "share"]).collect()}


def test_no_threshold_from_fitted_texts(spark):
    """Fewer trusted documents than the fitting sample takes: clean unlabelled texts of large and small languages stay."""
    rng = random.Random(16)
    rows = []
    for lang, n in (("x", 160), ("y", 60), ("z", 24)):
        known = [f"{lang}{i}" for i in range(3000)]
        rows += [(len(rows) + i, " ".join(rng.choices(known, [1 / (1 + j) for j in range(3000)], k=80)), lang) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i % 2], "doc_id long, quality int, toxic int")
    got = kneser.judged(docs, labels).join(docs.select("doc_id"), "doc_id").collect()
    for lang, n in (("x", 80), ("y", 30), ("z", 12)):
        assert sum(r.kept for r in got if r.lang == lang and not r.doc_id % 2) >= 0.95 * n


@pytest.mark.parametrize("sent", [kneser.SENT_BYTES, 0])
def test_classifier_is_fitted_on_all_trusted_documents(spark, monkeypatch, sent):
    """Probabilities are those of a plain model of the other fold's trusted rows, however many a language has."""
    monkeypatch.setattr(kneser, "SENT_BYTES", sent)
    rng, known = random.Random(23), [f"p{i}" for i in range(300)]
    text = lambda k: " ".join(rng.choices(known, [1 / (1 + j) for j in range(300)], k=k))
    rows = [(i, text(rng.choice([0, 1, 2, 12])), "en") for i in range(1500)] + [(7, text(9), "de"), (None, text(5), "en"), (3000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, int(i < 1400), 0) for i in range(1480)], "doc_id long, quality int, toxic int")
    sides = {r.doc_id: r.f for r in docs.select("doc_id", kneser.fold("doc_id").alias("f")).collect()}
    trusted = [[t.split() for i, t, _ in rows if i is not None and i < 1400 and sides[i] == f] for f in (0, 1)]
    assert min(map(len, trusted)) > 600
    plain = [brute.KneserNey(t) for t in trusted]
    want = sorted((i or -1, len((t or "").split()) + 1, plain[1 - sides[i]].log10_prob((t or "").split())) for i, t, _ in rows)
    got = sorted((r.doc_id or -1, r.n_tokens, r.log10_prob) for r in kneser.judged(docs, labels).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(math.isclose(x[2], y[2], rel_tol=1e-5) for x, y in zip(got, want, strict=True))


def test_classifier_by_rounds_equals_sent_models(spark, monkeypatch):
    """Scores, contrasts and verdicts, with the columns asked for; chunks of a few texts and of one long text."""
    rng, known = random.Random(24), [f"s{i}" for i in range(200)]
    text = lambda k: " ".join(rng.choices(known, [1 / (1 + j) for j in range(200)], k=k))
    rows = [(i, text(rng.choice([0, 1, 40, 60])) + (" foul words" if i % 9 == 0 else ""), "en" if i % 3 else "de") for i in range(300)]
    rows += [(5, text(20), "en"), (None, text(30), "en"), (400, None, None), (401, "", "fr"), (402, text(5000), "en"), (None, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    docs = docs.withColumns({"row": F.struct(F.current_timestamp().alias("at"), F.array("lang").alias("l")), "sizes": F.lit("x")})
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 9 == 0)) for i in range(250)], "doc_id long, quality int, toxic int")
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "", r.text is None)
    for keep in (["doc_id", "text", "row", "sizes"], ["text", "doc_id"]):
        out = kneser.judged(docs, labels, keep=keep)
        plain = sorted(out.collect(), key=key)
        monkeypatch.setattr(kneser, "SENT_BYTES", 0)
        monkeypatch.setattr(kneser, "CHUNK_BYTES", 4096)
        rounds = kneser.judged(docs, labels, keep=keep)
        assert rounds.dtypes == out.dtypes
        got = sorted(rounds.collect(), key=key)
        monkeypatch.undo()
        assert len(got) == len(plain) == len(rows) and any(r.worst_words is not None for r in got)
        for one, two in zip(got, plain, strict=True):
            assert (one.kept, one.n_tokens, one.text, one.doc_id) == (two.kept, two.n_tokens, two.text, two.doc_id)
            assert all(math.isclose(one[c], two[c], rel_tol=1e-5, abs_tol=1e-6) for c in ("log10_prob", "threshold", "worst_words", "worst_passage"))


def test_few_toxic_words_in_clean_text(spark):
    """A handful of words in ordinary long text, as in the labelled toxic documents, is caught; clean texts stay."""
    rng, known, toxic = random.Random(17), [f"h{i}" for i in range(500)], [f"insult{i}" for i in range(8)]
    rows = [(i, rng.choices(known, [1 / (1 + j) for j in range(500)], k=400)) for i in range(400)]
    for i, text in rows[:120]:
        for _ in range(4):
            text[rng.randrange(400)] = rng.choice(toxic)
    docs = frame(spark, [(i, " ".join(t)) for i, t in rows])
    labels = spark.createDataFrame([(i, 1, int(i < 120)) for i in range(400) if i % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in kneser.judged(docs, labels).collect()}
    assert sum(not got[i] for i in range(0, 120, 2)) >= 40
    assert sum(got[i] for i in range(120, 400, 2)) >= 133


def test_classifier_spreads_its_sorts_and_sends_its_models_once(spark, monkeypatch):
    """Tasks that sort the sample's n-grams follow its documents; two passes over the texts read one broadcast."""
    docs = spark.createDataFrame([(i, f"good words all along n{i}", "en") for i in range(90)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    plans, sent = [], []

    def stored(df, label, *more, **figures):
        if label == "kn-counts":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, label, *more, **figures)

    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda context, value: sent.append(1) or broadcast(context, value))
    monkeypatch.setattr(kneser, "store", stored)
    monkeypatch.setattr(kneser, "TASK_DOCUMENTS", 16)
    assert kneser.judged(docs, labels, keep=["doc_id", "text"]).count() == 90
    assert len(plans) == 1 and re.search(r"RepartitionByExpression \[m#\d+, v#\d+L?\], 5\b", plans[0])
    assert len(sent) == 1


def test_memory_goes_back(monkeypatch):
    """What a task has freed leaves its process, and every task's stream ends with that."""
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("needs glibc")
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
    blocks = [np.ones(12_000) for _ in range(2000)]
    blocks = blocks[::40]  # the rest lies freed between these
    before = held()
    chunks.give_back()
    assert before - held() > 100 and len(blocks) == 50
    calls = []
    monkeypatch.setattr(chunks, "give_back", lambda: calls.append(1))
    assert list(chunks.tidy(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4]
    assert len(calls) == 2


# --- search


def test_search(spark):
    rows = [r for r in awkward(9, 150) if r[0] != 40] + [(40, "w1 w2 w3")]
    got = topk.search(frame(spark, rows), k=4, every=10).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(topk.SQL.replace("% 20", "% 10").replace("<= 10", "<= 4")).fetchall()
    same([(r.query_id, r.rank, r.doc_id, r.score) for r in got], want)


def test_search_in_small_blocks(spark, monkeypatch):
    for name, value in {"BLOCK": 8, "QUERIES": 3, "FREQUENT": 20, "STEP": 50, "SHARD_DOCUMENTS": 40, "GROUP_QUERIES": 4}.items():
        monkeypatch.setattr(topk, name, value)
    test_search(spark)


def test_search_in_many_rounds(spark, monkeypatch):
    """Many shards in rounds of one, one, two, four..., with fewer queries than shards, equal SQL."""
    for name, value in {"SHARD_DOCUMENTS": 9, "GROUP_QUERIES": 4, "FIRST_SHARDS": 1}.items():
        monkeypatch.setattr(topk, name, value)
    test_search(spark)


def test_shards_return_nothing_below_the_score_so_far(spark, monkeypatch):
    kept = {}
    store = topk.store
    monkeypatch.setattr(topk, "store", lambda df, label, **more: kept.setdefault(label, store(df, label, **more)))
    topk.search(frame(spark, awkward(9, 150)), k=4, every=10)
    index, asked = ([r.asDict() for r in kept[label].frame.collect()] for label in ("search-index", "search-queries"))
    n, mean = sum(len(r["lens"]) for r in index), sum(sum(r["lens"]) for r in index) / sum(len(r["lens"]) for r in index)
    search = lambda **more: {q: list(zip(d.tolist(), s.tolist())) for q, d, s in topk.search_shard(lambda: iter(index), lambda: iter(asked), 4, n, mean, **more)}
    whole = search()
    reach = {q: rows[1][1] for q, rows in whole.items() if len(rows) > 1}
    assert len(reach) > 5 and any(rows[-1][1] < reach.get(q, 0) for q, rows in whole.items())
    assert search(reach=reach) == {q: [r for r in rows if r[1] >= reach.get(q, 0)] for q, rows in whole.items()}
    assert search(reach=dict.fromkeys(whole, 1e9)) == {}


def test_a_shard_is_searched_in_pieces(spark, monkeypatch):
    """One piece's postings are laid out at a time, and the pieces' best documents are the shard's."""
    kept, sides, store, side = {}, [], topk.store, topk.Side
    monkeypatch.setattr(topk, "store", lambda df, label, **more: kept.setdefault(label, store(df, label, **more)))
    topk.search(frame(spark, awkward(9, 150)), k=4, every=10)
    index, asked = ([r.asDict() for r in kept[label].frame.collect()] for label in ("search-index", "search-queries"))
    monkeypatch.setattr(topk, "Side", lambda *a: sides.append(side(*a)) or sides[-1])
    n, mean = sum(len(r["lens"]) for r in index), sum(sum(r["lens"]) for r in index) / sum(len(r["lens"]) for r in index)
    search = lambda k: {q: list(zip(d.tolist(), s.tolist())) for q, d, s in topk.search_shard(lambda: iter(index), lambda: iter(asked), k, n, mean)}
    whole = {k: search(k) for k in (1, 4, 500)}
    total = len(sides[1].terms)
    assert len(index) > 1 and len(whole[4]) > 5 and [len(s.terms) for s in sides[1::2]] == [total] * 3
    sides.clear()
    monkeypatch.setattr(topk, "PIECE_POSTINGS", 1, raising=False)
    for k, want in whole.items():
        assert search(k) == want
    assert len(sides) == len(whole) * (1 + len(index))  # each time the queries, then every piece
    assert sum(len(s.terms) for s in sides[1 : 1 + len(index)]) == total > 2 * max(len(s.terms) for s in sides[1 : 1 + len(index)])


@pytest.mark.parametrize("small", [False, True])
def test_search_with_null_and_repeated_ids(spark, monkeypatch, small):
    """Null ids that rank first take no place, rows of one id are one query and one document, as in SQL."""
    for name, value in {"BLOCK": 8, "QUERIES": 3, "FREQUENT": 20, "STEP": 50, "SHARD_DOCUMENTS": 40, "GROUP_QUERIES": 4}.items() if small else ():
        monkeypatch.setattr(topk, name, value)
    rows = awkward(9, 150)
    rows += [(40, "w1 w2 w3"), (40, rows[50][1]), (47, rows[30][1]), (47, None)]
    rows += [(None, rows[i][1]) for i in (20, 20, 20, 20, 20, 30, 30, 30, 30, 30, 50, 60)]
    got = topk.search(frame(spark, rows), k=4, every=10).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(topk.SQL.replace("% 20", "% 10").replace("<= 10", "<= 4")).fetchall()
    same([(r.query_id, r.rank, r.doc_id, r.score) for r in got], want)


# --- empty tables


def test_empty_tables(spark):
    docs = frame(spark, [(1, "x")]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = pages(spark, [(1, "http://a.b/", "", "a", "n", 1)]).where("page_id < 0")
    for got in (
        packing.pack(docs), jaccard.similarity_classes(docs), rules.ledger(docs), urls.judge(none), bilinear.score(docs),
        mixing.plan(docs), mixing.mixed(docs), kneser.judged(docs, labels), topk.search(docs),
    ):
        assert got.count() == 0
