"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import ann, bpe, licenses, mixing, phrases, pii, prefix_trie, quality, secrets_crf, simhash, spotsigs, token_count, toxicity
from .common import documents, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    made = bpe.encode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"),
                      want=("n_tokens", "ids_text", "decoded"))
    return made.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_count.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle_words=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of the held-out fifth are not used."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def span_digest(spans: str, kinds: tuple[str, ...] | None = None):
    """kind:start:end of each span, comma-joined, as SQL text over ``spans``."""
    chosen = spans if kinds is None else f"filter({spans}, s -> s.kind IN ({', '.join(repr(k) for k in kinds)}))"
    return F.expr(f"array_join(transform({chosen}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secrets_crf.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = secrets_crf.KINDS[:3]
    counts = [F.expr(f"size(filter(secrets, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(span_digest("secrets", base), 256).alias("base_sha256"),
                        span_digest("secrets").alias("spans"))


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op10_spotsigs")
def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness."""
    rows = spotsigs.with_next(documents(spark, sf_dir)).withColumn("edited", spotsigs.edited())
    rows = spotsigs.with_signatures(rows, F.col("edited"), "edited_sigs")
    return rows.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint("sigs").alias("fingerprint"), spotsigs.fingerprint("edited_sigs").alias("edited_fingerprint"),
        spotsigs.likeness("sigs", "edited_sigs").alias("near_edited"), spotsigs.likeness("sigs", "next_sigs").alias("near_next"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find_personal_data(documents(spark, sf_dir))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(span_digest("base"), 256).alias("base_sha256"), span_digest("spans").alias("spans"))


@query("op8_ann")
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every fiftieth vector."""
    ship(spark)
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


@query("op2_licenses")
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document.  Documents have no paths, so they are filed
    as source/lang/<hundred of the id>/<id>.txt; the first id of each hundred
    stands for that folder's LICENSE file."""
    docs = documents(spark, sf_dir)
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
                       F.floor(F.col("doc_id") / 100).cast("string"), name)
    return licenses.scan(docs.withColumn("path", path), keep=("doc_id",)) \
        .select("doc_id", "path", "own", "own_score", "licence", "inherited_from")


@query("op13_phrases", sql="""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
g AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS o(k)) GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS p FROM g WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, cut,
         (1000000 * c.f::HUGEINT * c.f::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(p[1:cut], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(p[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(p[1:2], ' ') AS phrase, f FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(p[2:3], ' '), f FROM c WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * a),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of every language."""
    return phrases.collocations(documents(spark, sf_dir))


@query("op12_prefix_trie", sql="""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
kept AS (SELECT i.conv_id, i.h, count(b.pos) AS m FROM ids i LEFT JOIN t b ON b.conv_id = i.base AND b.pos <= i.h GROUP BY ALL),
turns AS (
  SELECT i.conv_id, t.pos, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.base AND t.pos <= i.h
  UNION ALL SELECT k.conv_id, t.pos - k.h + k.m, t.role, t.text FROM kept k JOIN t ON t.conv_id = k.conv_id AND t.pos > k.h),
convs AS (
  SELECT i.conv_id, coalesce(list({'r': role, 't': text} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS seq
  FROM ids i LEFT JOIN turns t USING (conv_id) GROUP BY ALL),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM (SELECT conv_id, depth, seq[1:depth] AS path, len(seq) = depth AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM convs))
  GROUP BY depth, path),
up AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.path[n.depth].t) END AS saved
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1])
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, CAST(sum((u.n_children = 0)::INT) AS BIGINT) AS n_leaves,
       CAST(sum(u.saved) AS BIGINT) AS saved_tokens, v.ends_sha256
FROM up v JOIN up u ON u.depth >= v.depth AND u.path[1:v.depth] = v.path
GROUP BY v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, v.ends_sha256
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, with shared starts."""
    turns = prefix_trie.positions(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.shared_starts(turns))


@query("op11_quality")
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; neither labels nor texts of the held-out fifth are learnt from."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")
