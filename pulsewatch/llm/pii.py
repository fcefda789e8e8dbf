"""Personal data by exact patterns and bootstrapped contexts, in DataFrame
expressions only.

The exact matches are seeds.  The two words before a seed are a lexical
pattern; other identifier-like tokens (with a digit, outside the seeds) are
candidates.  On the graph of patterns and instances Spark scores a few rounds:
a pattern by the mean score of its distinct instances, a candidate by its best
pattern, seeds staying at one.  Candidates of patterns that end with high
confidence and enough seeds are accepted as the pattern's kind; they are seeds
of the next rounds, until no more are accepted, and become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text

KINDS = ("email", "ip", "card", "phone")
# The patterns of the exact kinds, written so that no start inside a run is
# tried again: a run is entered at its beginning or right after a match (\G),
# and runs are possessive, so very long runs cost linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A candidate starts at a word or after a sign that opens a value, and ends
# before brackets and quotes.
CANDIDATE = r"""(?<![^\s<(\[{"'`:=])[^\s0-9<>()\[\]{}"'`]*+[0-9][^\s<>()\[\]{}"'`]*+"""
#: Signs and white space that may stand between a context and its mention.
SPACE, OPENERS = "\t\n\x0b\f\r", "<([{\"'`:="
#: The words before a mention are looked for in its last so many characters, then in the whole text before it.
NEAR_CHARS = 128
SPAN = "struct<start:int,kind_at:int,end:int,kind:string,found:string>"


def valid(kind: str, m: str) -> str:
    """SQL condition that match ``m`` of a kind passes its check."""
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', ltrim('0', p)) AS int) <= 255)"
    if kind == "card":
        digits = f"translate({m}, ' -', '')"
        double = "(CASE WHEN pmod(length(g) - i, 2) = 0 THEN int(substr(g, i, 1)) WHEN int(substr(g, i, 1)) > 4 THEN 2 * int(substr(g, i, 1)) - 9 ELSE 2 * int(substr(g, i, 1)) END)"
        luhn = f"aggregate(sequence(1, length(g)), 0, (t, i) -> t + {double}) % 10 = 0"
        return f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN exists(array({digits}), g -> {luhn}) ELSE false END"
    if kind == "phone":
        return f"length(regexp_replace({m}, '[^0-9]', '')) BETWEEN 9 AND 15"
    return "true"


def _matches(text: str, pattern: str) -> Column:
    """Array of (start, end, found) of a pattern's matches in a text column."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pair = F.array(F.struct(found.alias("m"), pieces.alias("g")))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.flatten(F.transform(pair, _located))) \
        .otherwise(F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)"))


def _located(p: Column) -> Column:
    """(start, end, found) from the matches m and the pieces g between them;
    lengths count code points."""
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,found:string>>))")

    def step(a: Column, i: Column) -> Column:
        begin = a["at"] + F.length(F.get(p["g"], i))
        end = begin + F.length(F.get(p["m"], i))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), F.get(p["m"], i).alias("found")))).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(p["m"]) - 1), start, step, lambda a: a["out"])


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base``: the spans (start, kind_at, end, kind, found) of the exact
    kinds by start, then kind as listed."""
    for kind, pattern in PATTERNS.items():
        df = df.withColumn(f"_{kind}", _matches(text, pattern))
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(f"transform(filter(_{kind}, s -> {valid(kind, 's.found')}), s -> "
                     f"named_struct('start', s.start, 'kind_at', {k}, 'end', s.end, 'kind', '{kind}', 'found', s.found))")
    return df.withColumn("base", F.expr(f"array_sort(concat({', '.join(parts)}))")).drop(*[f"_{k}" for k in KINDS])


def _quoted(chars: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in chars) + "'"


def _two_words(prefix: str) -> str:
    """SQL: (pattern, sure) of the text before a mention: its last two words in
    lower case, signs that open a value left out; ``sure``: white space stands
    before them, so they are whole whatever came earlier."""
    bare = f"trim(TRAILING {_quoted(' ' + OPENERS)} FROM translate({prefix}, {_quoted(SPACE)}, '     '))"
    second = "substring_index(b, ' ', -1)"
    first = "substring_index(f, ' ', -1)"
    return (f"transform(transform(array({bare}), b -> named_struct('second', {second}, 'gap', length(b) < length({prefix}), "
            f"'f', rtrim(left(b, length(b) - length({second}))))), x -> transform(array(x.f), f -> named_struct("
            f"'pattern', CASE WHEN x.gap AND x.second <> '' AND f <> '' THEN lower(concat({first}, ' ', x.second)) END, "
            f"'sure', f <> '' AND length({first}) < length(f)))[0])[0]")


def with_contexts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``mentions``: (start, end, found, kind, pattern) of the seeds (kind
    set) and of the candidates (kind null); pattern: the two words before, from
    the whole text, in lower case, null if there are not two."""
    free = "filter(_candidates, c -> NOT exists(base, b -> c.start < b.end AND b.start < c.end))"
    near = _two_words(f"substring({text}, greatest(s.start - {NEAR_CHARS}, 0) + 1, least(s.start, {NEAR_CHARS}))")
    whole = _two_words(f"left({text}, s.start)")
    pattern = f"transform(array({near}), n -> CASE WHEN n.sure OR s.start <= {NEAR_CHARS} THEN n.pattern ELSE {whole}.pattern END)[0]"
    shape = "named_struct('start', s.start, 'end', s.end, 'found', s.found, 'kind', {kind}, 'pattern', " + pattern + ")"
    return df.withColumn("_candidates", _matches(text, CANDIDATE)).withColumn("mentions", F.expr(
        f"concat(transform(base, s -> {shape.format(kind='s.kind')}), "
        f"transform({free}, s -> {shape.format(kind='cast(null as string)')}))")).drop("_candidates")


def bootstrap(mentions: DataFrame, rounds: int = 3, confidence: float = 0.8, seeds: int = 3) -> DataFrame:
    """(pattern, found, kind) of the candidates accepted, from rows (pattern,
    found, kind), kind null for candidates.  A pattern accepts its candidates
    with at least ``seeds`` distinct seeds of one kind and ``confidence`` in it
    after ``rounds`` of scores; its other contexts take nothing from a candidate.
    The accepted are seeds of the next epoch.  More seeds never lower a score,
    so the accepted only grow and it ends when none is added.  Rows without a
    pattern take no part."""
    edges = staged(mentions.where("pattern IS NOT NULL").groupBy("pattern", "found").agg(
        *[F.max((F.col("kind") == k).cast("double")).alias(k) for k in KINDS]).na.fill(0.0, list(KINDS)), "pii-graph")
    own = edges.where(F.greatest(*KINDS) > 0).select("found").distinct().withColumn("known", F.lit(True))
    # a text that is a seed anywhere is no candidate elsewhere
    edges = staged(edges.join(own, "found", "left").withColumn("candidate", F.col("known").isNull()).drop("known"), "pii-scores")
    settled, known = 0, None
    while True:
        # s_: the seeds' scores, which stay
        scored = edges.select("pattern", "found", "candidate", *[F.col(k).alias(f"s_{k}") for k in KINDS], *KINDS)
        if known is not None:
            one = known.groupBy("found").agg(*[F.max((F.col("kind") == k).cast("double")).alias(f"a_{k}") for k in KINDS])
            now = {k: F.greatest(F.col(k), F.coalesce(f"a_{k}", F.lit(0.0))) for k in KINDS}
            scored = edges.join(one, "found", "left").select(
                "pattern", "found", "candidate", *[c.alias(f"s_{k}") for k, c in now.items()], *[c.alias(k) for k, c in now.items()])
        for r in range(rounds):
            patterns = scored.groupBy("pattern").agg(
                *[F.avg(k).alias(f"p_{k}") for k in KINDS], *[F.sum((F.col(f"s_{k}") > 0).cast("int")).alias(f"n_{k}") for k in KINDS])
            joined = scored.join(patterns, "pattern")
            if r + 1 < rounds:
                best = joined.where("candidate").groupBy("found").agg(*[F.max(f"p_{k}").alias(f"m_{k}") for k in KINDS])
                scored = staged(joined.join(best, "found", "left").select(
                    "pattern", "found", "candidate", *[F.col(f"s_{k}") for k in KINDS],
                    *[F.greatest(f"s_{k}", F.coalesce(f"m_{k}", F.lit(0.0))).alias(k) for k in KINDS]), "pii-scores")
        kinds = F.array(*[F.struct(F.col(f"p_{k}").alias("p"), F.col(f"n_{k}").alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("kind"))
                          for i, k in enumerate(KINDS)])
        accepted = staged(joined.where("candidate").select("pattern", "found", F.explode(
            F.filter(kinds, lambda c: (c["p"] >= confidence) & (c["n"] >= seeds))).alias("c")).select("pattern", "found", "c.*"), "pii-accepted")
        known = accepted.select("found", "kind").distinct()
        count = known.count()
        if count == settled:
            return accepted.groupBy("pattern", "found").agg(F.max(F.struct("p", "order", "kind")).alias("best")) \
                .select("pattern", "found", F.col("best.kind").alias("kind"))
        settled = count


def find_personal_data(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``base`` and ``spans``: arrays of (start, kind_at, end,
    kind, found) of every whole text by start, then kind as listed; ``spans``
    holds the base ones and those the contexts add.  Code points, end
    exclusive.

    Null text is the empty text (no spans).  Rows are independent but for the
    learned contexts: repeated rows stay repeated and copies count once in the
    graph.  An empty table gives no rows; columns other than ``keep`` are not
    read.
    """
    src = df.select(*[F.col(f"`{c}`") for c in keep], whole_text(text_col).alias("__text"))
    made = with_contexts(with_base(src, "__text"), "__text").drop("__text").withColumn("__row", F.monotonically_increasing_id())
    rows = staged(made, "pii-rows")
    mentions = rows.select("__row", F.explode("mentions").alias("m")).select("__row", "m.*")
    accepted = bootstrap(mentions)
    more = mentions.where("kind IS NULL AND pattern IS NOT NULL").drop("kind").join(accepted, ["pattern", "found"]) \
        .groupBy("__row").agg(F.collect_list(F.struct(
            "start", F.expr(f"array_position(array({', '.join(repr(k) for k in KINDS)}), kind) - 1").cast("int").alias("kind_at"),
            "end", "kind", "found")).alias("more"))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as array<{SPAN}>)")))))
    return rows.join(more, "__row", "left").select(*[F.col(f"`{c}`") for c in keep], "base", spans.alias("spans"))
