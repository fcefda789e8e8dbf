"""SpotSigs document fingerprints, in DataFrame expressions only.

A signature is a common-word anchor with the chain of the next content words
after it (other common words are skipped).  A text's fingerprint is its set
of signatures; likeness is the Jaccard coefficient of two sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, whole_text
from .components import connected_components

# FIXED VALUES: common words of English, German, French and Spanish that anchor signatures.
ANCHORS = (
    "a an and are as at be but by can do for from had has have he her his i if in is it its not of on or she "
    "so that the their there they this to was we were which will with you "
    "aber als auch auf aus bei das dem den der des die ein eine einer er es für ich im ist mit nach nicht sich sie sind "
    "und von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour "
    "que qui sa se ses son sur un une vous "
    "al como con del el ella entre era esta este fue ha hay las lo los más me mi muy no para pero por porque "
    "sin sobre su sus también tan te tiene todo una uno y ya"
).split()

WORD_GAP = r"[^\p{L}\p{N}]+"
CHAIN = 2
#: Ids per bucket when rows are put in id order; buckets of buckets hold this many.
BUCKET, BUCKETS = 128, 4096


def signatures(text: Column, chain: int = CHAIN) -> list[tuple[str, Column]]:
    """Steps (column, expression) that lead from a text to its sorted array of
    distinct signature hashes, the last column named ``_signatures``.

    A text without anchors counts every content word as one; a text without
    words has the hash of the text as its only signature.  Equal texts have
    equal signatures.
    """
    common = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))
    following = ", ".join(f"get(_content, at + {i})" for i in range(chain))
    return [
        ("_plain", text),
        ("_words", F.filter(F.split(F.lower("_plain"), WORD_GAP), lambda w: w != "")),
        ("_content", F.expr(f"filter(_words, w -> w NOT IN ({common}))")),
        ("_places", F.expr(f"filter(transform(_words, (w, i) -> if(w IN ({common}), i, -1)), i -> i >= 0)")),
        # an anchor at place p with r anchors before it is followed by content word p - r
        ("_signatures", F.expr(f"""array_sort(array_distinct(
            CASE WHEN size(_words) = 0 THEN array(xxhash64(_plain))
                 WHEN size(_content) = 0 THEN array(xxhash64(array_join(_words, ' ')))
                 WHEN size(_places) = 0 THEN transform(sequence(0, size(_content) - 1), at -> xxhash64('', {following}))
                 WHEN _places[0] >= size(_content) THEN array(xxhash64(array_join(_words, ' ')))
                 ELSE transform(filter(transform(_places, (p, r) -> named_struct('word', _words[p], 'at', p - r)),
                                       s -> s.at < size(_content)),
                                s -> xxhash64(s.word, {following.replace('at +', 's.at +')})) END))""")),
    ]


def with_signatures(df: DataFrame, text: Column, out_col: str) -> DataFrame:
    steps = signatures(text)
    for name, col in steps:
        df = df.withColumn(name, col)
    return df.withColumnRenamed("_signatures", out_col).drop(*[n for n, _ in steps[:-1]])


def fingerprint(signature_col: str) -> Column:
    """Size and 64-bit hash of a signature set, as text."""
    return F.concat_ws("-", F.size(signature_col), F.lpad(F.lower(F.hex(F.xxhash64(signature_col))), 16, "0"))


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard coefficient of two signature columns.  Sets whose sizes alone
    keep it below ``least`` are not intersected: 0."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = F.size(F.array_intersect(a, b))
    jaccard = same / (F.size(a) + F.size(b) - same)
    return F.when(small < large * F.lit(least), 0.0).otherwise(jaccard).cast("double")


def _next_bucket(ids: DataFrame) -> DataFrame:
    """(bucket, next_bucket): the next lower bucket that has rows; the lowest
    gets the highest.  Two levels, so that no window holds more than BUCKETS
    rows or one row for each BUCKET * BUCKETS ids."""
    b = ids.select("bucket").distinct().withColumn("super", F.floor(F.col("bucket") / BUCKETS))
    inside = b.withColumn("lower", F.lead("bucket").over(Window.partitionBy("super").orderBy(F.desc("bucket"))))
    tops = b.groupBy("super").agg(F.max("bucket").alias("top"))
    every = Window.orderBy(F.desc("super"))
    across = tops.select("super", F.coalesce(F.lead("top").over(every), F.first("top").over(every)).alias("across"))
    return inside.join(across, "super").select("bucket", F.coalesce("lower", "across").alias("next_bucket"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next_text, sigs, next_sigs) of each row, where next is the
    row after it by descending id (after the last: the first).

    Null text is the empty text.  Rows with the same id follow each other by
    descending text; rows with a null id come last.  Ids are bucketed, so one
    exchange of the texts serves all; only the first row of each bucket is
    fetched by a join.
    """
    rows = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")) \
        .withColumn("bucket", F.coalesce(F.floor(F.col("id") / BUCKET), F.lit(-(1 << 60))))
    order = [F.desc_nulls_last("id"), F.desc("text")]
    window = Window.partitionBy("bucket").orderBy(*order)
    ids = rows.select("bucket", "id")
    firsts = ids.groupBy("bucket").agg(F.max("id").alias("top"))
    wanted = firsts.join(_next_bucket(ids).withColumnRenamed("bucket", "asker").withColumnRenamed("next_bucket", "bucket"), "bucket") \
        .select("asker", "top")
    wanted = staged(wanted, "bucket-tops")  # one row per bucket
    edge = rows.select("id", F.col("text").alias("edge_text")).join(wanted, F.col("id").eqNullSafe(F.col("top"))) \
        .groupBy("asker").agg(F.max("edge_text").alias("edge_text"))
    edge = with_signatures(edge, F.col("edge_text"), "edge_sigs").withColumnRenamed("asker", "bucket")
    led = rows.withColumn("lead_text", F.lead("text").over(window))
    led = with_signatures(led, F.col("text"), "sigs").withColumn("lead_sigs", F.lead("sigs").over(window))
    return led.join(edge, "bucket", "left").select(
        "id", "text", F.coalesce("lead_text", "edge_text").alias("next_text"),
        "sigs", F.coalesce("lead_sigs", "edge_sigs").alias("next_sigs"))


def edited(text: str = "text", next_text: str = "next_text") -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as
    many (or all) of the next text."""
    return F.expr(f"concat(left({text}, length({text}) - floor(length({text}) / 2)), left({next_text}, floor(length({text}) / 2)))")


def near_duplicates(df: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) of every row: ``class_id`` is the smallest id reachable
    over likeness of at least ``least``; copies share a set, so only distinct
    sets are compared.

    Sets are partitioned by length (ranges in the ratio ``least``, so only
    neighbouring ranges can be alike), meet in an index on their rarest
    signatures (enough of them that alike sets share one) and are compared
    through the pruned Jaccard.  Null text is the empty text; a null id never
    names a class; an empty table gives no rows.
    """
    rows = staged(with_signatures(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), whole_text(), "sigs")
                  .select("id", F.xxhash64("sigs", F.size("sigs")).alias("set"), "sigs"), "spotsigs")
    sets = rows.groupBy("set").agg(F.min("id").alias("first"), F.any_value("sigs").alias("sigs"))
    sets = staged(sets, "spotsigs-sets")
    each = sets.select("set", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rare = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")  # alone: no partner
    ranked = each.join(rare, "sig").groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    # signatures that nobody shares come first in the order, so they use up prefix places
    prefix = F.expr(f"n - cast(ceil({least} * n) as int) + 1 - (n - size(by_df))")
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least)) + 1e-9)
    posts = ranked.withColumn("take", prefix).where("take > 0").withColumn("part", part) \
        .select("set", "n", "part", F.explode(F.slice("by_df", 1, F.col("take"))).alias("p")).select("set", "n", "part", F.col("p.sig").alias("sig"))
    left = posts.withColumn("at", F.explode(F.array("part", F.col("part") + 1)))
    right = posts.select(F.col("set").alias("set2"), F.col("n").alias("n2"), F.col("part").alias("at"), F.col("sig"))
    pairs = left.join(right, ["sig", "at"]).where((F.col("n") <= F.col("n2")) & (F.col("n") >= F.col("n2") * least) & (F.col("set") != F.col("set2"))) \
        .select("set", "set2").distinct()
    a = sets.select("set", F.col("sigs").alias("a"))
    b = sets.select(F.col("set").alias("set2"), F.col("sigs").alias("b"))
    links = pairs.join(a, "set").join(b, "set2").where(likeness("a", "b", least) >= least).select("set", "set2")
    labels = connected_components(links, "set", "set2").withColumnRenamed("node", "set")
    named = sets.join(labels, "set", "left").select("set", "first", F.coalesce("component", "set").alias("label"))
    least_id = named.groupBy("label").agg(F.min("first").alias("class_id"))
    return rows.join(named.join(least_id, "label").select("set", "class_id"), "set").select(F.col("id").alias(id_col), "class_id")
