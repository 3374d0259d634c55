"""Token counts against the library itself."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from test_operators import frame
from tokenizers import Tokenizer

from veilink.llm import registry, tokencount

SMALL = "/root/testdata/sf0.001"
PATH = tokencount.tokenizer_path(tokencount.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(PATH, tokencount.proven(PATH))


def tokens(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a \nb", "it's we'll I'D don't", "x<|endoftext|>y", " <|endoftext|>  <|endoftext|> ",
    "<|endoftext|", "tab\there", "\x1c \x1f a\x1cb", "\x85a \x85", "  a b c", "日本語 テスト", "😀 👩‍👩‍👧", "á ë", "½ ²3 ٣",
    "a " * 300, " " * 5000, "a" * 3000, "\n" * 70 + "x", "　a  b  ", "q՘ ࢏ \U00010ec5z", "0123456789" * 50, "SHA256: 9f86d0 $$$ -- ...",
    "a \x1cb c\x1c d", "a \x1cb  c\x1c d", "b ​c ​ d", "x \x85y z  w",
]


def test_counts_of_odd_texts(library, counter):
    for text in ODD:
        assert counter.text(text) == tokens(library, text), repr(text)
    assert counter.text(" ".join(ODD)) == tokens(library, " ".join(ODD))


shared = (Tokenizer.from_file(PATH), tokencount.Counter(PATH, tokencount.proven(PATH)))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab's1<|> "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_counts_of_any_text(text):
    assert shared[1].text(text) == tokens(shared[0], text)


def test_characters_up_to_the_bound_are_classed_as_in_the_library(library):
    for c in map(chr, range(0x558)):
        text = f"a{c}1{c}!{c} {c}"
        assert tokencount.PARTS.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_proven_strings(library):
    """Every proven string is one token; most of the vocabulary is proven; what is not proven is not one token."""
    whole = tokencount.proven(PATH)
    rng = random.Random(1)
    assert all(tokens(library, s) == 1 for s in rng.sample(sorted(whole), 3000))
    assert len(whole) > 45_000
    strings = list(tokencount.Vocabulary(PATH).strings())
    assert all(tokens(library, s) != 1 for s in strings if s not in whole)


def test_bounded_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencount, "KEPT_PIECES", 3)
    small = tokencount.Counter(PATH, frozenset())
    for text in ODD:
        assert small.text(text) == tokens(library, text)


def test_table_with_nulls_and_repeats(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(500, None), (None, "a b"), (7, "again"), (7, "again"), (501, "w " * 511 + "w"), (502, "w " * 512 + "w")]
    got = tokencount.token_counts(frame(spark, rows)).collect()
    want = [(i, len((t or "").encode()), n := tokens(library, t or ""), n > 512) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert [r.over_limit for r in got if r.doc_id in (501, 502)].count(True) == 1
    assert tokencount.token_counts(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_registered(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("text")).collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op13_token_counts(spark, SMALL).collect()}
    want = library.encode_batch([r.text or "" for r in docs], add_special_tokens=False)
    assert got == {r.doc_id: (len((r.text or "").encode()), len(e.ids), len(e.ids) > 512) for r, e in zip(docs, want, strict=True)}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokencount.Vocabulary(tokencount.tokenizer_path("word_bpe_49k.json"))
