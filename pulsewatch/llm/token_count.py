"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is run through the merges by itself; those
that end as the one token they name are proven to be whole: a pre-token equal
to such a string counts as one token without merging.  Only the other
pre-tokens are merged.

A text is first cut into pieces of an optional space and a run without white
space, or white space alone.  The pre-tokenizer never joins characters across
such a cut, so the count of a piece does not depend on its neighbours and is
kept in a bounded table per worker.
"""

from __future__ import annotations

import functools
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SPACE, Vocabulary, byte_symbols, remember
from .common import claim, map_texts, whole_text

#: Fixed value of the byte-level pre-tokenizer.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COUNT_ENTRIES = 1_500_000


class PieceCounts(dict):
    """Piece -> tokens; a missing piece is counted and kept."""

    def __init__(self, counter: "TokenCounter"):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        return remember(self, piece, self.counter.count_piece(piece), COUNT_ENTRIES)


class TokenCounter(Vocabulary):
    def __init__(self, path: str):
        super().__init__(path)
        self.pre_tokens = regex.compile(BYTE_PATTERN).findall
        self.pieces = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
        self.whole = self.prove_whole()
        self.counts = PieceCounts(self)
        self.words: dict[str, int] = {}

    def prove_whole(self) -> frozenset[str]:
        """The vocabulary strings (as text) that encode alone as one token."""
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        out = set()
        for token, i in self.vocab.items():
            raw = bytes(byte_of[c] for c in token)
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token by itself
            if self.merge_text(text) == [i]:
                out.add(text)
        return frozenset(out)

    def count_piece(self, piece: str) -> int:
        whole, words, n = self.whole, self.words, 0
        for pre in self.pre_tokens(piece):
            if pre in whole:
                n += 1
                continue
            k = words.get(pre)
            if k is None:
                k = remember(words, pre, len(self.merge_text(pre)))
            n += k
        return n

    def count(self, text: str) -> int:
        parts = self.special_cut.split(text)
        if len(parts) == 1:
            return sum(map(self.counts.__getitem__, self.pieces.findall(text)))
        return sum([1 if p in self.special else sum(map(self.counts.__getitem__, self.pieces.findall(p))) for p in parts])


@functools.lru_cache(maxsize=4)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(df: DataFrame, vocab_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 limit: int = 1024) -> DataFrame:
    """``keep`` plus n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)
    of every whole text.

    Null text is read as the empty text: 0 bytes, 0 tokens, not over the
    limit.  Rows are independent: repeated rows stay repeated, an empty table
    gives no rows, other columns are not read.
    """
    clash = set(keep) & {"n_bytes", "n_tokens", "over_limit"}
    if clash:
        raise ValueError(f"kept columns clash with outputs: {sorted(clash)}")
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"),
                    whole_text(text_col).alias("__text"))

    def start():
        claim("token counts", token_counter.cache_clear)
        count = token_counter(vocab_path).count
        return lambda texts: [[count(t) for t in texts]]

    counted = map_texts(src, "__text", [T.StructField("n_tokens", T.LongType())], start)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
