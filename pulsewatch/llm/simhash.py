"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``d`` differing bits are linked.  With the 64 bits cut
into m groups and thresholds t_1..t_m (each >= -1) that sum to d - m + 1, two
such fingerprints differ in at most t_i bits within some group i.  The groups
hold correlated bits; m and the thresholds come from dynamic programming over
the estimated cost of probes and candidates.  Every distinct fingerprint posts
its bits of each group, probes all values within t_i bits of them, and each
candidate pair is verified inside the join.

Buckets that hold more fingerprints than a ball has values (many near copies)
are left out of that join: the fingerprints that reach one are linked through
shared midpoints instead.  Each lists all values within d / 2 bits; those that
list the same value are within d bits of each other and get one edge each to
the smallest of them; any two within d bits share a value.  This is linear in
the fingerprints and loses no link between components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, staged, whole_text
from .components import connected_components

BITS = 64
SEED = 42
#: Shingles hashed at once: bounds the memory of one very long text.
BLOCK = 1 << 16
#: Cost of checking one candidate pair against emitting one probe row.
CANDIDATE_COST = 0.05


def simhash(text: str, shingle_words: int) -> int:
    """Signed 64-bit fingerprint: bit i is 1 if set in over half of the XXH64
    hashes of the word shingles (fewer words: the whole sequence; none: 0)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    starts = [0, *itertools.accumulate([len(w) + 1 for w in words])]
    total, n = np.zeros(BITS, np.int64), len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(starts[lo:hi], starts[lo + k:hi + k])]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, shingle_words: int = 4, text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``fp`` (signed 64-bit) of every whole text; null text is
    the empty text (fingerprint 0).  One row per row."""
    src = df.select(*[F.col(f"`{c}`") for c in keep], whole_text(text_col).alias("__text"))
    return map_texts(src, "__text", [T.StructField("fp", T.LongType())],
                     lambda: lambda texts: [[simhash(t, shingle_words) for t in texts]])


def bit_statistics(points: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 counts of bits set together, over all ``fp``."""

    def run(batches: Iterator[pd.DataFrame]):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for pdf in batches:
            v = pdf["fp"].to_numpy(np.int64)
            bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(v)
        yield pd.DataFrame({"at": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n)})

    rows = points.select("fp").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bits into m groups of near equal width, correlated bits together."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = -(-len(free) // (m - g))
        own = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: corr[b, own].mean())
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def within(differ: np.ndarray) -> np.ndarray:
    """P(at most t of the bits differ) for t = 0..len, bits taken as independent."""
    dist = np.zeros(len(differ) + 1)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)


def allocate(n: int, both: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(bit mask, threshold) of each group that is probed, at the least
    estimated cost over the number of groups and the thresholds."""
    p = both.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[int, int]]] = (math.inf, [])
    for m in range(2, distance + 2):
        groups = group_bits(n, both, m)
        total = distance - m + 1 + m  # thresholds shifted by one: each >= 0
        reach = {0: (0.0, [])}
        for g in groups:
            close = within(differ[g])
            step: dict[int, tuple[float, list[tuple[int, int]]]] = {}
            for used, (cost, chosen) in reach.items():
                for shifted in range(min(total - used, len(g)) + 1):
                    t = shifted - 1
                    more = 0.0
                    if t >= 0:
                        probes = sum(math.comb(len(g), x) for x in range(t + 1))
                        more = n * (1 + probes) + CANDIDATE_COST * n * n * close[t]
                    mask = sum(1 << b for b in g)
                    if cost + more < step.get(used + shifted, (math.inf, []))[0]:
                        step[used + shifted] = (cost + more, chosen + ([(mask, t)] if t >= 0 else []))
            reach = step
        if total in reach and reach[total][0] < best[0]:
            best = reach[total]
    return best[1]


def flips(mask: int, most: int) -> list[int]:
    """All sets of at most ``most`` bits of ``mask``, as signed 64-bit values."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    out = [sum(c) for x in range(most + 1) for c in itertools.combinations(bits, x)]
    return [signed(v) for v in out]


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _exploded(points: DataFrame, rows: list[tuple[int, int, int]]) -> DataFrame:
    """(fp, part, key) for each (part, mask, flip) of ``rows``."""
    cols = [F.lit([r[i] for r in rows]) for i in range(3)]
    zipped = F.arrays_zip(cols[0].alias("part"), cols[1].alias("mask"), cols[2].alias("flip"))
    return points.select("fp", F.explode(zipped).alias("r")).select(
        "fp", F.col("r.part").alias("part"), F.col("fp").bitwiseAND(F.col("r.mask")).bitwiseXOR(F.col("r.flip")).alias("key"))


def link(points: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) whose
    components are those of all pairs within ``distance`` bits.  ``distance``
    is even (the midpoint balls need a middle)."""
    if distance % 2 or distance < 0:
        raise ValueError("distance must be even and not negative")
    spark = points.sparkSession
    none = spark.createDataFrame([], "a long, b long")
    n, both = bit_statistics(points)
    if n < 2 or distance == 0:
        return none
    plan = allocate(n, both, distance)
    index = _exploded(points, [(i, signed(m), 0) for i, (m, _) in enumerate(plan)])
    probe_rows = [(i, signed(m), f) for i, (m, t) in enumerate(plan) for f in flips(m, t)]
    ball = flips((1 << BITS) - 1, distance // 2)
    hot_size = max(16, len(ball) // len(probe_rows))
    hot = staged(index.groupBy("part", "key").count().where(F.col("count") > hot_size).select("part", "key"), "hot-buckets")
    probes = _exploded(points, probe_rows)
    n_hot = hot.count()
    cold = index if n_hot == 0 else index.join(hot, ["part", "key"], "left_anti")
    x, y = probes.alias("x").hint("merge"), cold.alias("y").hint("merge")
    pairs = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key"))
                   & (F.col("x.fp") < F.col("y.fp"))
                   & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance)) \
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    if n_hot == 0:
        return pairs
    dense = staged(probes.join(hot, ["part", "key"], "left_semi").select("fp").distinct(), "dense")
    near = dense.select("fp", F.explode(F.lit(ball)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    centre = near.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    # sizes before the explode say nothing about these two: never broadcast them
    stars = near.hint("merge").join(centre.hint("merge"), "mid").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(df: DataFrame, shingle_words: int = 4, distance: int = 4, text_col: str = "text",
                    id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: the id, ``keep``, ``fp``, ``component_id``
    (the smallest id reachable over links of at most ``distance`` bits, itself
    included) and ``component`` (the smallest fingerprint of the same set).

    Null and empty texts have fingerprint 0 and link like any other.  A null
    id never names a component: the smallest other id does, or null if there
    is none.  Repeated rows stay repeated; an empty table gives no rows; other
    columns are not read.
    """
    fps = staged(fingerprints(df, shingle_words, text_col, keep=(id_col, *keep)), "fingerprints")
    points = staged(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "points")
    labels = connected_components(link(points.select("fp"), distance))
    named = points.join(labels.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id", "component")
    return fps.join(of, "fp").select(id_col, *keep, "fp", "component_id", "component")
