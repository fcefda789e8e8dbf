"""Phrase collocations counted in quotient filters.

Texts are read in chunks.  A chunk numbers its own words, and its vocabulary
is joined to the numbers of all words that are frequent enough to be in a
candidate (a phrase is never more frequent than its words, so the others
cannot matter).  The n-grams of a chunk, packed from the word numbers, go
through an invertible permutation of their bits: the top bits are the shard
and the quotient, the rest is kept in full as the remainder, so a filter is a
compact and lossless table of counters.  A shard's filters are sorted, and
merging them adds the counters up.

A chunk holds at most ``CHUNK_WORDS`` words and one further text; a shard about
``SHARD_GRAMS`` n-grams, as many shards as the corpus needs.  What one task
holds is bounded by these, not by a language, a word or a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged, whole_text

CHUNK_WORDS = 1 << 21
SHARD_GRAMS = 1 << 21
ORDERS = (2, 3)

# Byte table: A-Z to lower case, the signs that end a piece to one mark that
# never occurs in UTF-8.
_MARK = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _MARK * 10)


def words_and_marks(text: bytes) -> list[bytes]:
    """The words of a text in order, pieces ended by a mark."""
    return text.translate(_TABLE).replace(_MARK, b" \xff ").split()


# ---- packed n-grams ---------------------------------------------------------------------------

ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


class Packing:
    """Keys of n-grams of ``order`` word numbers below 2^``bits``.

    A key is one 64-bit word where the numbers fit, else one word a number.
    ``width`` bits of the first word are permuted."""

    def __init__(self, order: int, bits: int):
        self.order, self.bits = order, bits
        self.narrow = order * bits <= 64
        self.width = order * bits if self.narrow else 64
        self.mask = np.uint64((1 << self.width) - 1)
        self.half = np.uint64((self.width + 1) // 2)

    def keys(self, columns: list[np.ndarray]) -> np.ndarray:
        """Permuted keys, one row an n-gram, of its word numbers by place."""
        columns = [c.astype(np.uint64) for c in columns]
        if self.narrow:
            x = columns[0]
            for c in columns[1:]:
                x = (x << np.uint64(self.bits)) | c
            x = (x * np.uint64(ODD)) & self.mask
            x ^= x >> self.half
            return ((x * np.uint64(ODD)) & self.mask).reshape(-1, 1)
        first = columns[0] * np.uint64(ODD) + self._spread(columns[1:])
        return np.stack([first, *columns[1:]], axis=1)

    def numbers(self, keys: np.ndarray) -> list[np.ndarray]:
        """The word numbers of permuted keys, by place."""
        if self.narrow:
            x = (keys[:, 0] * np.uint64(INVERSE)) & self.mask
            x ^= x >> self.half
            x = (x * np.uint64(INVERSE)) & self.mask
            low = np.uint64((1 << self.bits) - 1)
            return [((x >> np.uint64(self.bits * (self.order - 1 - i))) & low).astype(np.int64) for i in range(self.order)]
        rest = [keys[:, i] for i in range(1, self.order)]
        return [c.astype(np.int64) for c in ((keys[:, 0] - self._spread(rest)) * np.uint64(INVERSE), *rest)]

    @staticmethod
    def _spread(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * np.uint64(ODD)
            h ^= h >> np.uint64(29)
        return h


def add_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts (each 1 if not given).
    Sorted runs, as filters give them, are merged rather than sorted anew."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    if keys.shape[1] == 1 and counts is None:
        one, n = np.unique(keys[:, 0], return_counts=True)
        return one.reshape(-1, 1), n
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, np.any(keys[1:] != keys[:-1], axis=1)))
    counts = np.ones(len(keys), np.int64) if counts is None else counts[order]
    return keys[starts], np.add.reduceat(counts, starts)


# ---- quotient filter --------------------------------------------------------------------------

def pack_filter(keys: np.ndarray, counts: np.ndarray, low: int) -> bytes:
    """A counting quotient filter of sorted distinct keys of one shard.

    Of the first word's ``low`` bits below the shard the top ones are the
    quotient: per quotient its run of entries in unary, one bit an entry.  The
    other bits are stored per entry as whole bytes, then a counter byte; counts
    of 255 and more follow in full."""
    m = len(keys)
    q = min(low, max(1, (m - 1).bit_length()))
    body = keys[:, 0] & np.uint64((1 << low) - 1)
    runs = np.bincount((body >> np.uint64(low - q)).astype(np.int64), minlength=1 << q)
    bits = np.ones(m + (1 << q), np.uint8)
    bits[np.cumsum(runs + 1) - 1] = 0
    rest = body & np.uint64((1 << (low - q)) - 1)
    size = (low - q + 7) // 8
    large = counts >= 255
    return b"".join([np.array([m, q, large.sum()], "<u4").tobytes(), np.packbits(bits).tobytes(),
                     np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(m, 8)[:, :size]).tobytes(),
                     *[np.ascontiguousarray(keys[:, i]).astype("<u8").tobytes() for i in range(1, keys.shape[1])],
                     np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()])


def unpack_filter(blob: bytes, shard: int, low: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (``columns`` words each) and counts that a filter holds."""
    m, q, n_large = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    at = 12
    used = (m + (1 << q) + 7) // 8
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, used, at))[:m + (1 << q)]
    at += used
    quotient = np.cumsum(bits == 0)[bits == 1].astype(np.uint64)
    size = (low - q + 7) // 8
    rest = np.zeros((m, 8), np.uint8)
    rest[:, :size] = np.frombuffer(blob, np.uint8, m * size, at).reshape(m, size)
    at += m * size
    first = rest.reshape(-1).view("<u8").astype(np.uint64) | (quotient << np.uint64(low - q))
    if low < 64:
        first |= np.uint64(shard << low)
    keys = [first]
    for _ in range(1, columns):
        keys.append(np.frombuffer(blob, "<u8", m, at).astype(np.uint64))
        at += 8 * m
    counts = np.frombuffer(blob, np.uint8, m, at).astype(np.int64)
    at += m
    counts[counts == 255] = np.frombuffer(blob, "<i8", n_large, at)
    return np.stack(keys, axis=1), counts


# ---- words ------------------------------------------------------------------------------------

CHUNKS = "chunk long, lang string, word string, local int, n long, seq binary"


class _Numbers(dict):
    """Word -> local number, new words numbered in turn (0 is the end of a piece)."""

    def __init__(self, taken: list):
        super().__init__({_MARK: 0})
        self.taken = taken

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.taken)
        self.taken.append(word)
        return number


def chunks(df: DataFrame, text_col: str, lang_col: str, chunk_words: int) -> DataFrame:
    """Rows of two kinds: (chunk, lang, word, local, n) of a chunk's vocabulary,
    and (chunk, seq), its texts as local numbers (int32)."""
    ship(df.sparkSession)
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        langs, taken, parts, n = {}, [_MARK], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            seq = np.concatenate(parts)
            counts = np.bincount(seq, minlength=len(taken))
            of = np.empty(len(taken), object)
            for lang, numbers in langs.items():
                of[list(numbers.values())] = lang
            local = np.arange(1, len(taken), dtype=np.int32)
            size = len(local)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, base + made)), pa.array(of[1:], pa.string()), pa.array([w.decode("utf-8", "replace") for w in taken[1:]], pa.string()),
                 pa.array(local), pa.array(counts[1:].astype(np.int64)), pa.nulls(size, pa.binary())], names=CHUNK_NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()),
                 pa.array([seq.astype("<i4").tobytes()], pa.binary())], names=CHUNK_NAMES)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, lang in enumerate(batch.column(0).to_pylist()):
                found = words_and_marks(texts[i].as_py())
                if not found:
                    continue
                numbers = langs.get(lang)
                if numbers is None:
                    numbers = langs[lang] = _Numbers(taken)
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                parts.append(np.zeros(1, np.int32))
                n += len(found)
                if n >= chunk_words:
                    yield from close()
                    langs, taken, parts, n, made = {}, [_MARK], [], 0, made + 1
        if parts:
            yield from close()

    return staged(rows.mapInArrow(run, CHUNKS), "phrase-chunks")


CHUNK_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]


def frequent_words(vocabulary: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(id, lang, word, f) of the words with ``least`` occurrences in their
    language, and the bits of the largest id.  Ids start at 1 and are nearly
    dense: row numbers of the written partitions, interleaved."""
    counted = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    made = staged(counted.withColumn("place", F.monotonically_increasing_id()), "phrase-words")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    top = made.agg(F.max(part).alias("part"), F.max(row).alias("row")).first()
    parts, rows = (top["part"] or 0) + 1, (top["row"] or 0) + 1
    return made.select((row * parts + part + 1).alias("id"), "lang", "word", "f"), (parts * rows + 1).bit_length()


# ---- n-grams ----------------------------------------------------------------------------------

def count_grams(made: DataFrame, words: DataFrame, bits: int, shard_bits: int, least: int) -> DataFrame:
    """(g1, g2, g3, a) of every n-gram of ``words`` that occurs ``least`` times
    or more; g3 is null in pairs."""
    packings = {k: Packing(k, bits) for k in ORDERS}
    lows = {k: p.width - min(shard_bits, p.width - 1) for k, p in packings.items()}

    def build(text: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in text["seq"]:
            seq = np.frombuffer(blob, "<i4")
            ids = np.zeros(int(seq.max()) + 1, np.int64)
            ids[names["local"].to_numpy()] = names["id"].to_numpy()
            g = ids[seq]
            for order, packing in packings.items():
                n = max(0, len(g) - order + 1)
                columns = [g[i:i + n] for i in range(order)]
                whole = np.logical_and.reduce([c > 0 for c in columns])
                keys, counts = add_up(packing.keys([c[whole] for c in columns]))
                shards = (keys[:, 0] >> np.uint64(lows[order])).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
                for low, high in zip(cuts, [*cuts[1:], len(shards)]):
                    out.append((order, int(shards[low]), pack_filter(keys[low:high], counts[low:high], lows[order])))
        return pd.DataFrame(out, columns=["gram", "shard", "filter"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order, shard = int(key[0]), int(key[1])
        packing = packings[order]
        parts = [unpack_filter(blob, shard, lows[order], 1 if packing.narrow else order) for blob in pdf["filter"]]
        keys, counts = add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        enough = counts >= least
        columns = packing.numbers(keys[enough])
        third = pd.array(columns[2], "Int64") if order == 3 else pd.array([None] * int(enough.sum()), "Int64")
        return pd.DataFrame({"g1": columns[0], "g2": columns[1], "g3": third, "a": counts[enough]})

    names = made.where("seq IS NULL").select("chunk", "lang", "word", "local").join(words.select("lang", "word", "id"), ["lang", "word"]) \
        .select("chunk", "local", "id")
    filters = made.where("seq IS NOT NULL").select(F.col("chunk").alias("of"), "seq").groupBy("of").cogroup(names.groupBy("chunk")) \
        .applyInPandas(build, "gram int, shard long, filter binary")
    return filters.groupBy("gram", "shard").applyInPandas(merge, "g1 long, g2 long, g3 long, a long")


# ---- collocations -----------------------------------------------------------------------------

HOT_SHARE = 1000


def _looked_up(df: DataFrame, on: list[str], found: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``df`` with the columns of ``found`` whose ``keys`` equal ``on``.

    Keys that hold a thousandth of all occurrences or more, a thousand at most,
    are broadcast; so no key of the shuffled join is hot."""
    values = [c for c in found.columns if c not in keys]
    hot = found.where(F.col(weight) * HOT_SHARE >= F.lit(total))
    cold = found.where(F.col(weight) * HOT_SHARE < F.lit(total))
    near = hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_hit"))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & (F.col(c) == F.col(f"_h{i}"))
    df = df.join(F.broadcast(near), same, "left").drop(*[f"_h{i}" for i in range(len(keys))])
    # rows already answered get keys that match nothing and are spread
    spread = -1 - F.pmod(F.xxhash64(*df.drop("_hit").columns), F.lit(1 << 40))
    df = df.withColumn("_k0", F.when(F.col("_hit").isNull(), F.col(on[0])).otherwise(spread))
    far = cold.select(F.col(keys[0]).alias("_k0"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys) if i],
                      F.struct(*values).alias("_far"))
    same = df["_k0"] == far["_k0"]
    for i, c in enumerate(on[1:], 1):
        same = same & (df[c] == far[f"_k{i}"])
    df = df.join(far, same, "left").withColumn("_hit", F.coalesce("_hit", "_far"))
    return df.select(*[c for c in df.columns if not c.startswith("_")], "_hit")


def _score(l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), exact: counts under 1e16 keep every product
    within 38 digits."""
    return F.expr(f"CAST((1000000 * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0))) AS BIGINT)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, inside_share: int = 50, top: int = 2000,
                 chunk_words: int = CHUNK_WORDS, shard_grams: int = SHARD_GRAMS, bits: int | None = None) -> DataFrame:
    """Phrases of two or three words by language: lang, rank, phrase, a, l, r,
    n, score.

    A null language is ``und``, null and empty texts have no words, repeated
    rows count as often as they occur, and an empty table gives no rows.  Equal
    scores go by count, then by the phrase's bytes, so ranks are unique.  Other
    columns are not read.  ``bits`` widens the word numbers (for tests)."""
    made = chunks(docs, text_col, lang_col, chunk_words)
    vocabulary = made.where("seq IS NULL").select("lang", "word", "n")
    by_lang = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    words, needed = frequent_words(vocabulary, least)
    shard_bits = max(0, (total // shard_grams).bit_length())
    grams = staged(count_grams(made, words, max(needed, bits or 0), shard_bits, least), "phrase-grams")

    one = words.select("id", "lang", "word", "f")
    pairs = grams.where("g3 IS NULL").select("g1", "g2", "a")
    pairs = _looked_up(pairs, ["g1"], one, ["id"], "f", total).select("g1", "g2", "a", F.col("_hit.lang").alias("lang"), F.col("_hit.word").alias("w1"), F.col("_hit.f").alias("f1"))
    pairs = _looked_up(pairs, ["g2"], one, ["id"], "f", total).select("g1", "g2", "a", "lang", "w1", "f1", F.col("_hit.word").alias("w2"), F.col("_hit.f").alias("f2"))
    pairs = staged(pairs, "phrase-pairs")

    triples = grams.where("g3 IS NOT NULL")
    weighed = pairs.select("g1", "g2", F.col("a").alias("m"), "lang", "w1", "w2", "f1", "f2")
    triples = _looked_up(triples, ["g1", "g2"], weighed, ["g1", "g2"], "m", total).select(
        "g1", "g2", "g3", "a", *[F.col(f"_hit.{c}").alias(n) for c, n in (("lang", "lang"), ("w1", "w1"), ("w2", "w2"), ("f1", "f1"), ("m", "f12"))])
    triples = _looked_up(triples, ["g2", "g3"], weighed, ["g1", "g2"], "m", total).select(
        "g1", "g2", "g3", "a", "lang", "w1", "w2", "f1", "f12", *[F.col(f"_hit.{c}").alias(n) for c, n in (("w2", "w3"), ("f2", "f3"), ("m", "f23"))])
    triples = triples.withColumn("s1", _score("f1", "f23")).withColumn("s2", _score("f12", "f3"))
    later = F.col("s2") < F.col("s1")
    long = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(later, F.col("f12")).otherwise(F.col("f1")).alias("l"),
                          F.when(later, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))

    # a pair inside a longer candidate that is frequent enough beside it
    around = grams.where("g3 IS NOT NULL").select(F.explode(F.array(F.struct("g1", "g2", "a"), F.struct(F.col("g2").alias("g1"), F.col("g3").alias("g2"), "a"))).alias("p")) \
        .groupBy(F.col("p.g1").alias("g1"), F.col("p.g2").alias("g2")).agg(F.max("p.a").alias("most"))
    kept = pairs.join(around, ["g1", "g2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside_share * F.col("a")))
    short = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f1", "f2").alias("score"))

    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = short.unionByName(long).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(by_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
