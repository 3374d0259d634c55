"""Hash families on bigrams, without big integers.

A digest is read as a big-endian integer and reduced modulo the filter length by Horner's rule over
32-bit chunks of its hexadecimal form.  All intermediate values fit in a bigint.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of the hash families.
DOUBLE = "DoubleHash"
TRIPLE = "TripleHash"
ENHANCED = "EnhancedDHash"
FAMILIES = (DOUBLE, TRIPLE, ENHANCED)

CHUNK = 8


def digest_residue(hex_digest: Column, digits: int, modulus: Column) -> Column:
    """Residue of a hexadecimal digest of ``digits`` digits."""
    step = F.pmod(F.lit(1 << 32), modulus)
    starts = F.array(*[F.lit(i) for i in range(1, digits + 1, CHUNK)])
    chunks = F.transform(starts, lambda i: F.conv(hex_digest.substr(i, F.lit(CHUNK)), 16, 10).cast("bigint"))
    return F.aggregate(chunks, F.lit(0).cast("bigint"), lambda acc, c: F.pmod(acc * step + c, modulus))


def residues(token: Column, modulus: Column, families: set[str]) -> dict[str, Column]:
    """Residues of a token's digests under their column names; the widest digest only if a family uses it."""
    raw = F.encode(token, "UTF-8")
    found = {
        "md5_mod": digest_residue(F.md5(raw), 32, modulus),
        "sha256_mod": digest_residue(F.sha2(raw, 256), 64, modulus),
    }
    if TRIPLE in families:
        found["sha512_mod"] = digest_residue(F.sha2(raw, 512), 128, modulus)
    return found


def enhanced_term(round_no: Column, mode: str = "literal") -> Column:
    """Cubic term of the enhanced family.

    ``literal`` is the term as data already encoded with it has it, (c XOR (3 - c)) / 6 cut towards zero;
    ``published`` is (c^3 - c) / 6.
    """
    if mode == "published":
        return (round_no * round_no * round_no - round_no) / F.lit(6)
    if mode == "literal":
        return round_no.bitwiseXOR(F.lit(3) - round_no) / F.lit(6)
    raise ValueError(f"unknown enhanced mode {mode!r}")


def position(
    family: Column, round_no: Column, modulus: Column, families: set[str], mode: str = "literal"
) -> Column:
    """Bit position of hash round ``round_no`` (1..k) from the residue columns."""
    term = F.lit(0).cast("bigint")
    if ENHANCED in families:
        term = F.when(family == ENHANCED, enhanced_term(round_no, mode).cast("bigint")).otherwise(term)
    if TRIPLE in families:
        triangle = (round_no * (round_no - 1) / F.lit(2)).cast("bigint")
        term = F.when(family == TRIPLE, triangle * F.col("sha512_mod")).otherwise(term)
    return F.pmod(F.col("md5_mod") + round_no * F.col("sha256_mod") + term, modulus)
