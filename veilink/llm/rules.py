"""Quality rules as a ledger of bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and one long whose bit *i* says that rule
*i* failed.  A policy is a named, versioned set of rules: applying it, comparing versions and asking what each rule does
alone are bit operations on that column, without another look at any text.

Everything is DataFrame expressions: a text is split once into an array and its windows are compared by sorting hashes
within the row, so no row leaves its task.  Null text has no words, hence fails the base rules; columns beyond id and
text pass through nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# name -> condition of failure over the measurements; the place in this mapping is the rule's bit
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "capitals": "100 * n_capitals > 60 * word_chars",
    "exclamations": "100 * n_exclamations > 10 * word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BASE = ("few_words", "repeated_words")
# versions of the production policy; the last is the one in force
POLICIES: dict[int, tuple[str, ...]] = {
    1: BASE,
    2: (*BASE, "symbols", "duplicate_lines", "capitals", "exclamations"),
    3: (*BASE, "symbols", "duplicate_lines", "capitals", "exclamations", "short_words", "long_words"),
}


def _once(value: Column, use) -> Column:
    """use(value) with ``value`` computed a single time per row."""
    return F.transform(F.array(value), use)[0]


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that are found twice or more.

    Windows are sorted as (hash, place) in one long: the place takes as many low bits as the count of words needs and
    the hash the others, and neighbours with equal hashes are held against each other word by word.
    """
    same = lambda a, b: (words[a] == words[b]) & (words[a + 1] == words[b + 1]) & (words[a + 2] == words[b + 2])

    def with_bits(n: Column, bits: Column, mask: Column) -> Column:
        place = lambda key: key.bitwiseAND(mask).cast("int")
        head = lambda key: F.call_function("shiftrightunsigned", key, bits)

        def twin(key: Column, other: Column) -> Column:
            return F.coalesce((head(key) == head(other)) & same(place(key), place(other)), F.lit(False))

        def places(keys: Column) -> Column:
            found = F.transform(
                keys,
                lambda key, i: F.when(twin(key, F.get(keys, i - 1)) | twin(key, F.get(keys, i + 1)), place(key)).otherwise(-1),
            )
            return F.sort_array(F.filter(found, lambda p: p >= 0))

        def covered(found: Column) -> Column:
            steps = F.transform(found, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(found, i + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

        named = lambda p: F.xxhash64(words[p], words[p + 1], words[p + 2])
        keys = F.transform(
            F.sequence(F.lit(0), n - 3), lambda p: F.call_function("shiftleft", named(p), bits).bitwiseOR(p.cast("long"))
        )
        return _once(F.sort_array(keys), lambda k: _once(places(k), covered))

    bits_of = lambda n: F.length(F.bin(n)).cast("int")
    mask_of_bits = lambda bits: F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return _once(
        F.size(words),
        lambda n: F.when(n < 4, F.lit(0).cast("long")).otherwise(
            _once(bits_of(n), lambda bits: _once(mask_of_bits(bits), lambda mask: with_bits(n, bits, mask)))
        ),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """One row per document: measurements and ``fails``, the bits of the failed rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    measured = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select(
        "doc_id",
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        _count_of(F.col("_text"), "!").cast("long").alias("n_exclamations"),
        _once(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_lines"),
        _once(
            F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+", -1), ""),
            lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")),
        ).alias("_words"),
    )
    measured = measured.select(
        "doc_id", F.col("_words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("_lines.n").cast("long").alias("n_lines"),
        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"),
        F.col("_words.r").alias("n_repeat_words"), "n_capitals", "n_exclamations",
    )
    fails = F.lit(0).cast("long")
    for bit, condition in enumerate(rules.values()):
        fails = fails.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fails", fails)


def mask_of(names: Sequence[str], rules: Mapping[str, str] = RULES) -> int:
    """The bits of a policy's rules."""
    order = list(rules)
    return sum(1 << order.index(name) for name in names)


def apply_policy(marked: DataFrame, names: Sequence[str], column: str = "kept") -> DataFrame:
    """The ledger with a verdict: kept where no rule of the policy failed."""
    return marked.withColumn(column, F.col("fails").bitwiseAND(F.lit(mask_of(names)).cast("long")) == 0)


def ablations(marked: DataFrame, names: Sequence[str]) -> DataFrame:
    """For every rule of a policy: documents it fails, those it alone rejects, those kept without it."""
    mask = F.lit(mask_of(names)).cast("long")
    hit = F.col("fails").bitwiseAND(mask)
    sums = [F.count_if(hit == 0).alias("kept")]
    for name in names:
        bit = F.lit(mask_of([name])).cast("long")
        sums += [
            F.count_if(hit.bitwiseAND(bit) != 0).alias(f"{name}_fails"),
            F.count_if(hit == bit).alias(f"{name}_alone"),
        ]
    totals = marked.agg(*sums)
    rows = [
        F.struct(
            F.lit(name).alias("rule"), F.col(f"{name}_fails").alias("fails"), F.col(f"{name}_alone").alias("alone"),
            (F.col("kept") + F.col(f"{name}_alone")).alias("kept_without"),
        )
        for name in names
    ]
    return totals.select(F.inline(F.array(*rows)))


SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split),
windows AS (
  SELECT doc_id, p, word AS a, lead(word) OVER d AS b, lead(word, 2) OVER d AS c
  FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
again AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
hit AS (SELECT doc_id, count(DISTINCT p + o) AS n_repeat FROM again, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1 GROUP BY doc_id),
lined AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS caps, length(t) - length(replace(t, '!', '')) AS bangs
  FROM split LEFT JOIN hit USING (doc_id) LEFT JOIN lined USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > word_chars OR 100 * n_dup_lines > 50 * n_lines OR 100 * caps > 60 * word_chars
    OR 100 * bangs > 10 * word_chars OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM judged
"""
