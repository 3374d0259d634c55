"""Token counts by the whole-token shortcut: most pre-tokens are one entry of the vocabulary and need no merging.

Offline, on the driver, every string of the vocabulary is put through the splitting and the merges alone; those that come
out as one token are *proven* (``proven``).  The vocabulary bounds this set, and it travels with the plan.  In the tasks a
pre-token that is proven counts one; only the others are merged.

A text is cut at single spaces between two characters that are no white space.  No pre-token crosses such a place and no
rule looks across it, so a piece's count depends on the piece alone and is remembered (a bounded memory, emptied when
full).  Strings of added tokens inside a text are one token each, as in the library.

The splitting is repeated here for code points up to U+0557, where pattern and library class every character alike;
pieces with others are split by the library, whose Unicode tables are of another version.

Nothing is shuffled.  Defined results: a null text is empty and has no tokens; null and repeated ids are rows like others;
other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from veilink.llm import chunks
from veilink.llm.packing import SHOWN, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
KEPT_PIECES, KEPT_LENGTH = 400_000, 64
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# White space and the splitting rule of byte-level vocabularies.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
PARTS = regex.compile(SPLIT)
CUTS = regex.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")
SETTLED = regex.compile(r"[\x00-\u0557]*")
SPACES = frozenset(regex.findall(rf"[{WHITE}]", "".join(map(chr, range(0x3001)))))
UNSAFE = 1 << 50


class Vocabulary:
    """A byte-level BPE file: its splitting, its merges, the strings of its added tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        split = self.tokenizer.pre_tokenizer
        rules = json.loads(split.__getstate__()) if split else {}
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        if self.tokenizer.normalizer or rules.get("type") != "ByteLevel" or rules["add_prefix_space"] or not rules["use_regex"] or not plain:
            raise ValueError(f"{path} is no byte-level vocabulary with the usual splitting")
        specials = sorted((t.content for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")

    def parts(self, piece: str) -> list[str]:
        if SETTLED.fullmatch(piece):
            return PARTS.findall(piece)
        return [piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def merged(self, part: str) -> int:
        """Tokens of one pre-token by merging its bytes."""
        return len(self.tokenizer.model.tokenize("".join([SHOWN[b] for b in part.encode()])))

    def strings(self) -> Iterator[str]:
        """Vocabulary entries that are text."""
        byte_of = {c: b for b, c in enumerate(SHOWN)}
        for shown in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                yield bytes(byte_of[c] for c in shown).decode()
            except (KeyError, UnicodeDecodeError):
                continue


def proven(path: str) -> frozenset[str]:
    """The strings of the vocabulary that alone are one pre-token and merge into one token."""
    own = Vocabulary(path)
    return frozenset(s for s in own.strings() if not own.special.search(s) and own.parts(s) == [s] and own.merged(s) == 1)


class Counter(dict):
    """Token counts of pieces that follow a space, each worked out once."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        super().__init__()
        self.vocabulary, self.whole = Vocabulary(path), whole

    def count(self, piece: str) -> int:
        """Pre-tokens that are proven count one, the rest are merged."""
        whole, merged = self.whole, self.vocabulary.merged
        return sum(1 if part in whole else merged(part) for part in self.vocabulary.parts(piece))

    def __missing__(self, piece: str) -> int:
        # split at every space, a piece of white space or with white space at an end marks a place that is no cut
        edge = not piece or piece[0] in SPACES or piece[-1] in SPACES
        n = UNSAFE if edge else self.count(" " + piece)
        if len(piece) <= KEPT_LENGTH:
            self[piece] = n
        return n

    def segment(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        first, *rest = text.split(" ")
        n = sum(map(self.__getitem__, rest)) if first and first[-1] not in SPACES else UNSAFE
        if n >= UNSAFE:  # some of these spaces are no cuts
            first, *rest = CUTS.split(text)
            n = sum(self.get(piece) or self._fresh(piece) for piece in rest)
        return n + (self.count(first) if first else 0)

    def _fresh(self, piece: str) -> int:
        n = self.count(" " + piece)
        if len(piece) <= KEPT_LENGTH and " " in piece:
            self[piece] = n
        return n

    def text(self, text: str) -> int:
        if len(self) > KEPT_PIECES:
            self.clear()
        segments = self.vocabulary.special.split(text)
        return sum(map(self.segment, segments)) + len(segments) - 1


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT,
    whole: frozenset[str] | None = None,
) -> DataFrame:
    """One row per document: its UTF-8 bytes, its tokens, and whether they are more than ``limit``.

    ``whole`` is the result of ``proven`` for that file, if it is already at hand.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    known, schema = proven(path) if whole is None else whole, chunks.arrow_schema(COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, known)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            tokens = pa.array([counter.text(texts[i].as_py()) for i in range(len(texts))], pa.int64())
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens, pc.greater(tokens, limit)], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(count, COUNTS)
