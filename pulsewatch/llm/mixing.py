"""Mixing sources to target weights by pivotal dependent rounding, in
DataFrame expressions only.

Each source's target is a fractional number of copies of each of its
documents.  Whole copies are taken as they are; the fractions are rounded
by pairs: words move at random from one document of a pair to the other until
one of them is taken whole or not at all, and the other goes on to the next
pair.  Expected copies and the words of a pair are kept exactly.

Rows that agree in id, source and size are paired with each other first.  As
their sizes are equal, that comes to a count: of n rows with fraction p the
whole part of n * p is taken and one row is left with the rest, so such rows
are counted before the shuffle and go on as one.

Pairs are then formed among documents of one source and one power of two of
size, in blocks of bounded size; what is left of a block (one document at most)
goes up a reduction tree until a class has at most ROOT left.  Those of a source
meet at the root and are settled from the largest down, each rounding passing
its error on to the next smaller, so a source ends within about half of its
smallest remaining document of its target.  (Choices at random at the root too
would keep the expected copies of these few, but leave a source of a hundred
documents 3 to 6 % off and one of ten up to 28 %.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, whole_text

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
#: Documents of a size class that meet at the root, and rows counted as one item.
ROOT, EQUAL = 8, 65_536


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size): words of every whole text, 0 for null."""
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                     F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"))


def targets(by_source: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, have the weights in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source and
    the excess is shared again by weight.  The level at which this ends is the
    largest over the sources, by rising cap per weight, of what the capped
    ones leave over the weights that remain.  One row per source.
    """
    turn = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (whole - capped) / left)
    return rows.withColumn("level", F.max("level").over(Window.partitionBy())) \
        .select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _pivot(items: str, salt: str) -> Column:
    """Fold of an array of (key, size, p), 0 < p < 1, into ``done``, an array of
    (key, take), and the document ``key``, ``size``, ``p`` left (key null: none).
    Random numbers are hashes of ``salt`` and the two keys."""
    # up: words that may move to the document held (a); down: from it
    up = "least((1 - a.p) * a.size, x.p * x.size)"
    down = "least(a.p * a.size, (1 - x.p) * x.size)"
    u = f"(pmod(xxhash64({salt}, a.key, x.key), 9007199254740992) / 9007199254740992D)"
    keep_a = "named_struct('key', a.key, 'size', a.size, 'p', {p}, 'done', concat(a.done, array(named_struct('key', x.key, 'take', {take}))))"
    keep_x = "named_struct('key', x.key, 'size', x.size, 'p', {p}, 'done', concat(a.done, array(named_struct('key', a.key, 'take', {take}))))"
    full = "(1 - a.p) * a.size <= x.p * x.size"  # moving up, the held one is taken whole first
    none = "a.p * a.size <= (1 - x.p) * x.size"  # moving down, the held one is left out first
    step = f"""CASE
        WHEN a.key IS NULL THEN named_struct('key', x.key, 'size', x.size, 'p', x.p, 'done', a.done)
        WHEN {u} * ({up} + {down}) < {down} THEN
            CASE WHEN {full} THEN {keep_x.format(p="x.p - (1 - a.p) * a.size / x.size", take=1)}
                 ELSE {keep_a.format(p="a.p + x.p * x.size / a.size", take=0)} END
        ELSE CASE WHEN {none} THEN {keep_x.format(p="x.p + a.p * a.size / x.size", take=0)}
                  ELSE {keep_a.format(p="a.p - (1 - x.p) * x.size / a.size", take=1)} END END"""
    start = ("named_struct('key', cast(null as bigint), 'size', 0L, 'p', 0D, "
             "'done', cast(array() as array<struct<key:bigint,take:int>>))")
    return F.expr(f"aggregate({items}, {start}, (a, x) -> {step})")


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), one row per row.

    ``copies`` is a whole number up to ``most``, ``taken`` is copies times
    size.  Random choices come from hashes of ids, so reruns agree.  Null
    text has size 0 and, like empty text, takes no words and stays as one
    copy; a null source is a
    source of its own, last in order; rows with the same id, source and size are
    rounded as one item of at most EQUAL rows, others each by itself; an empty table gives no rows; other columns are not read.
    """
    same = sizes(df, id_col, text_col, source_col).groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    # equal rows in items of bounded size, each dealt to a block of its own
    items = same.withColumn("item", F.explode(F.expr(f"sequence(0L, (rows - 1) div {EQUAL})"))) \
        .withColumn("rows", F.least(F.lit(EQUAL).cast("long"), F.col("rows") - F.col("item") * EQUAL))
    rows = staged(items.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) + 1e-9)).otherwise(-1)), "sizes")
    by_class = rows.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("words"))
    by_source = staged(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), "sources")
    goal = targets(by_source, weights, share, most) \
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)) \
        .withColumn("whole", F.floor(F.col("ratio") + 1e-12)) \
        .withColumn("part", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    goal = goal.withColumn("part", F.when(F.col("part") > 1e-12, F.col("part")).otherwise(0.0)).drop("ratio")
    plan = staged(by_class.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
                  .select("c.source", "class", "n", "source_size", "target", "whole", "part"), "mix-plan")
    largest = plan.agg(F.max("n")).first()[0] or 0
    known = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.class") == F.col("p.class"))) \
        .select("id", "r.source", "r.class", "size", "rows", "item", "n", "source_size", "target", "whole", "part")
    settled = known.where("part = 0 OR size = 0").select(
        "id", "source", "size", "source_size", "target", "rows", F.when(F.col("size") > 0, F.col("whole")).otherwise(1).alias("low"),
        F.lit(0).cast("bigint").alias("more"))

    # blocks of about BLOCK items, dealt by hash; ROOT blocks at least, so that each class sends several to the root
    keyed = known.where("part > 0 AND size > 0") \
        .withColumn("key", F.xxhash64("id", "size", "item", F.lit(seed))) \
        .withColumn("width", F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(ROOT).cast("bigint"))) \
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("width")))
    group = ["source", "class", "block"]
    first = keyed.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("key", "id", "size", "item", "rows"))).alias("docs"),
        *[F.first(c).alias(c) for c in ("source_size", "target", "whole", "part", "width")])
    # of the equal rows of an item the whole part of rows * part is taken, one row has the rest
    first = first.withColumn("docs", F.expr("""transform(docs, d -> named_struct('id', d.id, 'size', d.size, 'rows', d.rows,
        'more', cast(floor(d.rows * part + 1e-9) as bigint), 'p', greatest(d.rows * part - floor(d.rows * part + 1e-9), 0D)))"""))
    # inside a block documents go by their place
    first = first.withColumn("fold", _pivot("filter(transform(docs, (d, i) -> named_struct('key', cast(i as bigint), 'size', d.size, 'p', d.p)), x -> x.p > 1e-9)",
                                            f"source, class, block, {seed}"))
    first = staged(first, "mix-blocks")

    levels = []
    left = first.where("fold.key IS NOT NULL").select(*group, "width", F.col("fold.size").alias("size"), F.col("fold.p").alias("p"))
    span = -(-largest // BLOCK)
    while span > ROOT:
        up = left.withColumn("width", F.greatest(F.ceil(F.col("width") / BLOCK), F.lit(ROOT).cast("bigint"))) \
            .withColumn("above", F.pmod(F.col("block"), F.col("width"))).groupBy("source", "class", "above").agg(
            F.array_sort(F.collect_list(F.struct(F.col("block").alias("key"), "size", "p"))).alias("items"), F.first("width").alias("width"))
        up = staged(up.withColumn("fold", _pivot("items", f"source, class, above, {seed + 1 + len(levels)}")), "mix-level")
        levels.append(up)
        left = up.where("fold.key IS NOT NULL").select("source", "class", F.col("above").alias("block"), "width", F.col("fold.size").alias("size"), F.col("fold.p").alias("p"))
        span = -(-span // BLOCK)
    # root: at most ROOT of each of the 64 classes of a source, largest first, each passing on the words it is off
    root = left.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "class", "block", "p")), asc=False).alias("items"))
    asked = "x.p * x.size + a.owed"
    root = root.withColumn("done", F.expr(f"""aggregate(items, named_struct('owed', 0D, 'done', cast(array() as array<struct<class:bigint,block:bigint,take:int>>)),
        (a, x) -> named_struct('owed', {asked} - if(2 * ({asked}) >= x.size, x.size, 0),
                               'done', concat(a.done, array(named_struct('class', x.class, 'block', x.block, 'take', if(2 * ({asked}) >= x.size, 1, 0))))),
        a -> a.done)"""))
    told = root.select("source", F.explode("done").alias("d")).select("source", "d.class", "d.block", "d.take")
    for up in reversed(levels):
        kept = _told(up.withColumnRenamed("above", "block"), told)
        told = staged(kept.select("source", "class", F.explode(_decided("fold", "take")).alias("d"))
                      .select("source", "class", F.col("d.key").alias("block"), "d.take"), "mix-told")
    final = _told(first, told).withColumn("takes", F.map_from_entries(_decided("fold", "take"))).select(
        "source", "source_size", "target", "whole", F.explode(F.expr(
            "transform(docs, (d, i) -> named_struct('id', d.id, 'size', d.size, 'rows', d.rows, "
            "'more', d.more + coalesce(takes[cast(i as bigint)], 0)))")).alias("d"))
    rounded = final.select("d.id", "source", "d.size", "source_size", "target", "d.rows", F.col("whole").alias("low"), "d.more")
    every = settled.unionByName(rounded).withColumn("place", F.explode(F.expr("sequence(1L, rows)"))) \
        .withColumn("copies", F.col("low") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0))
    return every.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _told(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """Blocks with the decision on the document left of each."""
    t = told.alias("t")
    return blocks.alias("b").join(t, F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("b.class") == F.col("t.class"))
                                  & (F.col("b.block") == F.col("t.block")), "left").select("b.*", "t.take")


def _decided(fold: str, take: str) -> Column:
    return F.expr(f"concat({fold}.done, if({fold}.key IS NULL, cast(array() as array<struct<key:bigint,take:int>>), "
                  f"array(named_struct('key', {fold}.key, 'take', {take}))))")


def apply_copies(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``df`` as often as ``mixed`` (made from it) says, same columns.
    Rows that agree in id, source and size share their copies out in the order
    of their texts."""
    key = ["__id", "__source", "__size"]
    counted = mixed.groupBy(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("size").alias("__size"), "copies") \
        .agg(F.count("*").alias("n"))
    counts = counted.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("copies", "n"))).alias("__counts"))
    rows = df.withColumn("__id", F.col(id_col)).withColumn("__source", F.col(source_col).cast("string")) \
        .withColumn("__size", F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long"))
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(whole_text(text_col))))
    on = (F.col("r.__id").eqNullSafe(F.col("c.__id"))) & (F.col("r.__source").eqNullSafe(F.col("c.__source"))) & (F.col("r.__size") == F.col("c.__size"))
    joined = rows.alias("r").join(counts.alias("c"), on).select("r.*", "c.__counts")
    copies = F.expr("""aggregate(__counts, named_struct('left', cast(__place as bigint), 'copies', cast(null as bigint)),
        (a, x) -> named_struct('left', a.left - x.n, 'copies', coalesce(a.copies, if(a.left <= x.n, x.copies, null))), a -> a.copies)""")
    return joined.withColumn("__copies", copies).where("__copies > 0") \
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in df.columns])
