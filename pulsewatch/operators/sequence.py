"""Row-ordered per-key sequences without one task per key.

Lags, leads and rolling frames "in rows" (the product's features are defined
in rows, not minutes) need each key's rows in order.  A plain
``Window.partitionBy(key)`` sorts a whole key in one task: a service that
holds a third of the table would then sit in a single task.  Here the order
is cut into fixed-size chunks instead:

1. ``row_index``: a global 0-based row number per key, computed from row
   numbers inside (key, day) buckets plus per-bucket offsets taken from a
   small (key, day) count table (its size is keys x days, independent of row
   volume).  No window ever spans more than one (key, day) bucket.
2. ``with_halo``: rows are grouped into chunks of ``chunk_rows`` consecutive
   indexes; the last ``before`` rows of each chunk are copied into the next
   chunk and the first ``after`` rows into the previous one, flagged
   ``_ctx``.  Any frame reaching at most ``before`` rows back and ``after``
   rows ahead is then exact inside ``partitionBy(key, _chunk)``; copies are
   dropped afterwards.  Extra rows: (before + after) / chunk_rows.

``chunk_rows=None`` keeps the simple one-partition-per-key plan (fine when
keys are many and each is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_ROWS = 100_000


def row_index(df: DataFrame, key: str = "service_id", ts: str = "window_start",
              tiebreak: tuple = (), bucketed: bool = True, bucket: str = "day") -> DataFrame:
    """Add ``_idx``: 0-based position of the row in its key's ``ts`` order.

    ``bucket`` is the ``date_trunc`` unit of the numbering partitions: a day
    holds at most 1 440 one-minute windows per key; use ``"hour"`` (or finer)
    for tables with many rows per key and day."""
    order = [F.col(ts)] + [F.col(c) for c in tiebreak]
    if not bucketed:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumn("_idx", F.row_number().over(w) - 1)
    b = df.withColumn("_bucket", F.date_trunc(bucket, F.col(ts)))
    wb = Window.partitionBy(key, "_bucket").orderBy(*order)
    indexed = b.withColumn("_rn", F.row_number().over(wb))
    # bucket sizes come from the numbered rows themselves, so both branches
    # share one shuffle (the exchange is reused) and the input is read once
    counts = indexed.groupBy(key, "_bucket").agg(F.max("_rn").alias("_n"))
    wc = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_base"))
    return indexed.join(offsets, [key, "_bucket"]) \
        .withColumn("_idx", F.col("_base") + F.col("_rn") - 1).drop("_bucket", "_rn", "_base")


def with_halo(indexed: DataFrame, before: int, after: int = 0,
              chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk`` and ``_ctx`` (copied halo rows) to an indexed frame."""
    if chunk_rows is None:
        return indexed.withColumn("_chunk", F.lit(0)).withColumn("_ctx", F.lit(False))
    c = max(int(chunk_rows), before + after + 1)
    own = f"CAST(floor(_idx / {c}) AS BIGINT)"
    pos = f"pmod(_idx, {c})"
    own_t = f"named_struct('_chunk', {own}, '_ctx', false)"
    nxt = f"CASE WHEN {pos} >= {c - before} THEN named_struct('_chunk', {own} + 1, '_ctx', true) END"
    prv = f"CASE WHEN {pos} < {after} AND {own} > 0 THEN named_struct('_chunk', {own} - 1, '_ctx', true) END"
    return indexed.selectExpr("*", f"inline(filter(array({own_t}, {nxt}, {prv}), x -> x IS NOT NULL))")


def halo_window(key: str = "service_id") -> Window:
    return Window.partitionBy(key, "_chunk").orderBy("_idx")


def sequenced(df: DataFrame, before: int, after: int = 0, key: str = "service_id",
              ts: str = "window_start", chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
              tiebreak: tuple = ()) -> DataFrame:
    """``row_index`` + ``with_halo`` in one call (bucketed index when chunked)."""
    idx = row_index(df, key, ts, tiebreak=tiebreak, bucketed=chunk_rows is not None)
    return with_halo(idx, before, after, chunk_rows)


def finish(df: DataFrame) -> DataFrame:
    """Drop halo copies and helper columns."""
    return df.filter(~F.col("_ctx")).drop("_ctx", "_chunk", "_idx")
