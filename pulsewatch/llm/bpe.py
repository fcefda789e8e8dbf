"""BPE encoding and decoding with a public vocabulary file.

Merging works on a segment tree over the ranks of adjacent pairs: the root
is the lowest rank and, among equals, the leftmost pair; a merge changes at
most three leaves, each in O(log n), until no mergeable pair is left.  A
pre-token of n symbols therefore costs O(n log n) however long it is.

Texts are cut at white space, which no pre-token of the supported
vocabularies crosses; each distinct piece is encoded once per worker and kept
in a bounded table.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from operator import itemgetter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, map_texts, ship, whole_text

#: White space as Unicode defines it (Python's own class also has U+001C..1F).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters that Python's split() takes for white space and Unicode does not.
ODD_SPACE = re.compile("[\x1c-\x1f]").search
CACHE_ENTRIES = 500_000
#: Longer pieces are encoded each time: they seldom recur and would fill the table.
CACHE_PIECE_CHARS = 64
NO_PAIR = 1 << 62


def byte_symbols() -> list[str]:
    """Printable stand-in of each byte: itself where printable, else the next
    free code point from 256 on (the public byte-level alphabet)."""
    keep = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


#: Up to so many symbols a scan of all pairs costs less than keeping a tree.
SHORT = 32


def merge_short(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """``merge`` by a scan of the pairs' ranks at each step: the same ids in
    O(n^2), for few symbols."""
    ids, get = list(symbols), ranks.get
    pairs = [get(a << 20 | b, NO_PAIR) for a, b in zip(ids, ids[1:])]
    while pairs and (low := min(pairs)) != NO_PAIR:
        i = pairs.index(low)
        ids[i] = now = merged[low]
        del ids[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(now << 20 | ids[i + 1], NO_PAIR)
        if i:
            pairs[i - 1] = get(ids[i - 1] << 20 | now, NO_PAIR)
    return ids


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply all merges to a list of token ids, lowest rank first, leftmost
    among equals.

    ``ranks`` maps left << 20 | right to the pair's rank, ``merged`` a rank to
    the merged id.  The tree's leaf i holds rank << bits | i of the pair that
    begins at symbol i, or NO_PAIR; inner nodes hold the minimum below them.
    """
    n = len(symbols)
    if n <= SHORT:
        return merge_short(symbols, ranks, merged)
    ids = list(symbols)
    get = ranks.get
    bits = n.bit_length()
    mask = (1 << bits) - 1
    size = 1 << (n - 2).bit_length()
    tree = [NO_PAIR] * (2 * size)
    left = ids[0]
    for i in range(1, n):
        right = ids[i]
        rank = get(left << 20 | right)
        if rank is not None:
            tree[size + i - 1] = rank << bits | i - 1
        left = right
    for i in range(size - 1, 0, -1):
        x, y = tree[2 * i], tree[2 * i + 1]
        tree[i] = x if x < y else y
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (low := tree[1]) != NO_PAIR:
        i = low & mask
        j = after[i]
        ids[i] = now = merged[low >> bits]
        ids[j] = -1
        k = after[i] = after[j]
        key, at = NO_PAIR, size + i
        if k < n:
            before[k] = i
            tree[size + j] = NO_PAIR  # the pair that began at the symbol merged away
            at_j = size + j
            rank = get(now << 20 | ids[k])
            if rank is not None:
                key = rank << bits | i
        else:
            at_j = 0
        tree[at] = key
        while at > 1:
            other = tree[at ^ 1]
            at >>= 1
            tree[at] = key = other if other < key else key
        at = at_j
        while at > 1:
            x, y = tree[at], tree[at ^ 1]
            at >>= 1
            if y < x:
                x = y
            if tree[at] == x:
                break
            tree[at] = x
        p = before[i]
        if p >= 0:
            rank = get(ids[p] << 20 | now)
            at = size + p
            key = NO_PAIR if rank is None else rank << bits | p
            tree[at] = key
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < key:
                    key = other
                if tree[at] == key:
                    break
                tree[at] = key
    return [x for x in ids if x >= 0]


class Vocabulary:
    """A byte-level BPE vocabulary read from a public tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab = vocab
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.byte_ids = [vocab[s] for s in symbols]
        self.last_ids = [vocab[s + self.suffix] for s in symbols]
        self.special_cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def merge_text(self, pre_token: str) -> list[int]:
        raw = pre_token.encode("utf-8", "surrogatepass")
        if not raw:
            return []
        ids = [self.byte_ids[b] for b in raw]
        ids[-1] = self.last_ids[raw[-1]]
        return merge(ids, self.ranks, self.merged)


#: Fixed value: the word vocabulary's pre-tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def remember(table: dict, key: str, value, most: int = CACHE_ENTRIES):
    """Keep a short key's value in a table of bounded size."""
    if len(key) <= CACHE_PIECE_CHARS:
        if len(table) >= most:
            table.clear()
        table[key] = value
    return value


class Known(dict):
    """The wanted outputs of pieces, made when first asked for: tokens, ids in
    decimal joined by spaces, decoded text, ids as 32-bit integers."""

    def __init__(self, tok: WordTokenizer, want: tuple[str, ...]):
        make = {"n_tokens": len, "ids_text": lambda ids: " ".join(map(str, ids)), "decoded": tok.decode, "ids": lambda ids: array("i", ids).tobytes()}
        self.encode, self.make = tok.encode_piece, [make[w] for w in want]

    def __missing__(self, piece: str) -> tuple:
        ids = self.encode(piece)
        return remember(self, piece, tuple([make(ids) for make in self.make]))


class WordTokenizer(Vocabulary):
    """Lower-cased words with word ends; white space is dropped."""

    def __init__(self, path: str):
        super().__init__(path)
        self.pre_tokens = regex.compile(WORD_PATTERN).findall
        self.pieces = re.compile(f"[^{SPACE}]+").findall
        self.words: dict[str, list[int]] = {}
        self.known = Known(self, ())
        self.wanted: tuple[str, ...] = ()

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # character by character: lower() of a whole string picks a final sigma
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        words, out = self.words, []
        for pre in self.pre_tokens(text):
            ids = words.get(pre)
            if ids is None:
                ids = remember(words, pre, self.merge_text(pre))
            out += ids
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece without white space."""
        if "<|" not in piece:
            return self._plain(piece)
        ids: list[int] = []
        for part in self.special_cut.split(piece):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._plain(part)
        return ids

    def cut(self, text: str) -> list[str]:
        """The pieces between white space."""
        return text.split() if not ODD_SPACE(text) else self.pieces(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.cut(text):
            out += self.encode_piece(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file has no decoder: token strings joined by a space;
        ids outside the vocabulary are skipped."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])

    def columns(self, text: str, want: tuple[str, ...]) -> list:
        """The wanted outputs of one text: ids, ids_text, decoded, n_tokens."""
        if want != self.wanted:  # the table holds what is wanted and nothing else
            self.known, self.wanted = Known(self, want), want
        found = list(map(self.known.__getitem__, self.cut(text)))
        join = {"n_tokens": sum, "ids_text": " ".join, "decoded": " ".join, "ids": lambda ids: np.frombuffer(b"".join(ids), np.int32)}
        return [join[w](map(itemgetter(i), found)) for i, w in enumerate(want)]


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process; its table lives as long as the worker."""
    return WordTokenizer(path)


OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "ids_text": T.StringType(),
           "decoded": T.StringType(), "n_tokens": T.LongType()}
def encode(df: DataFrame, vocab_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           want: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """Encode every whole text of ``df`` and return ``keep`` plus ``want``
    (of ids array<int>, ids_text, decoded, n_tokens).

    Null text is read as the empty text: no ids, empty strings, 0 tokens.
    Rows are independent, so repeated rows stay repeated, ties cannot occur, an
    empty table gives no rows; columns other than ``keep`` are not read, and a
    kept column may not bear the name of an output.
    """
    clash = set(keep) & set(want)
    if clash:
        raise ValueError(f"kept columns clash with outputs: {sorted(clash)}")
    src = df.select(*[F.col(f"`{c}`") for c in keep], whole_text(text_col).alias("__text"))

    def start():
        claim("bpe", word_tokenizer.cache_clear)
        tok = word_tokenizer(vocab_path)
        return lambda texts: list(zip(*[tok.columns(t, want) for t in texts]))

    return map_texts(src, "__text", [T.StructField(w, OUTPUTS[w]) for w in want], start)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add (or replace) the text that ``ids_col`` (array<int>) decodes to.  A null array and
    an empty one give the empty text; unknown and null ids are skipped."""
    ship(df.sparkSession)

    def decoded(ids: pd.Series) -> pd.Series:
        tok = word_tokenizer(vocab_path)
        return pd.Series([tok.decode([] if x is None else list(x)) for x in ids], dtype="str")

    return df.withColumn(out_col, F.pandas_udf(decoded, T.StringType())(F.col(ids_col)))
