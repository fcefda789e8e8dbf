"""Phrases, the prefix trie and the quality classifier against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewatch.llm import phrases, prefix_trie, quality

from .helpers import TEXTS, docs, none


# ---- phrases ----------------------------------------------------------------------------------

def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {q for p, b in cand.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * b >= 50 * cand.get(q, 10 ** 18)}
        rows_ = []
        for p, a in cand.items():
            if p in dropped:
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            rows_.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


CORPUS = [(i, " ".join(np.random.default_rng(i).choice(["new", "York", "CITY", "in", "a.", "hot", "dog,", "the\tthe", "é", "cat;x", "one\ntwo"], 60)),
           [None, "und", "en", "de"][i % 4]) for i in range(60)]


@pytest.mark.parametrize("bits", [None, 30])
def test_phrases_equal_plain_counts(spark, bits):
    df = spark.createDataFrame([(i, t, g, "x") for i, t, g in CORPUS], "doc_id long, text string, lang string, phrase string").repartition(3)
    got = phrases.collocations(df, least=4, top=40, chunk_words=150, shard_grams=100, bits=bits).collect()
    want = plain_collocations([(g, t) for _, t, g in CORPUS], 4, 40)
    assert sorted(tuple(r) for r in got) == want and len(want) > 60


def test_phrases_take_odd_rows(spark):
    got = phrases.collocations(docs(spark), top=5).collect()
    want = plain_collocations([("en", t) for _, t in TEXTS], 10, 5)
    assert sorted(tuple(r) for r in got) == want and want
    assert phrases.collocations(none(spark)).collect() == []


@pytest.mark.parametrize("order,bits,low", [(2, 9, 12), (3, 21, 50), (3, 3, 9), (2, 32, 64), (3, 30, 60), (2, 40, 64)])
def test_filter_is_lossless(order, bits, low):
    rng = np.random.default_rng(order * bits)
    columns = [rng.integers(1, 1 << bits, 4000) for _ in range(order)]
    packing = phrases.Packing(order, bits)
    keys = packing.keys(columns)
    assert all((a == b).all() for a, b in zip(packing.numbers(keys), columns))
    keys, counts = phrases.add_up(np.concatenate([keys, keys[:1000]]))
    counts[::7] += rng.integers(200, 10 ** 12, len(counts[::7]))
    low = min(low, packing.width)
    shard = keys[:, 0] >> np.uint64(low) if low < 64 else np.zeros(len(keys), np.uint64)
    for s in np.unique(shard):
        mine = shard == s
        back, n = phrases.unpack_filter(phrases.pack_filter(keys[mine], counts[mine], low), int(s), low, keys.shape[1])
        assert (back == keys[mine]).all() and (n == counts[mine]).all()


# ---- prefix trie ------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, unit string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = sorted(own.get(c - c % 5, []))
        seqs[c] = [x[2:] for x in base[:h]] + [x[2:] for x in sorted(own[c])[h:]]
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()), key=repr)


def conversations(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(200, 60, replace=False):
        for t in range(int(rng.integers(1, 14))):
            rows.append((int(c), None if rng.random() < 0.05 else t, [None, "user", "assistant"][rng.integers(3)], [None, "", "hi", "wörld", "ok ok"][rng.integers(5)]))
    rows += [(777, t, "user", f"turn {t % 7}") for t in range(90)] + [(778, 3, "user", "same")] * 40 + [(779, t, "user", f"turn {t % 7}") for t in range(80)]
    rows += [(None, 1, "user", "nobody"), (2 ** 62, 1, "user", "hi"), (12, 0, None, None), (12, 0, None, None)]
    return rows


@pytest.mark.parametrize("unit", [(4096, 65536), (9, 30), (30, 12)])
def test_trie_equals_plain(spark, unit):
    rows = conversations(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], CONV).repartition(5)
    turns = prefix_trie.shared_starts(prefix_trie.positions(df))
    got = sorted((tuple(r) for r in prefix_trie.trie(turns, *unit).collect()), key=repr)
    assert got == plain_trie(rows)


def test_trie_without_conversations(spark):
    for rows in ([], [(None, 1, "user", "x", "y")]):
        turns = prefix_trie.positions(spark.createDataFrame(rows, CONV))
        assert prefix_trie.trie(prefix_trie.shared_starts(turns)).collect() == []


# ---- quality ----------------------------------------------------------------------------------

def test_prior_and_risk_against_plain_sums():
    rng = np.random.default_rng(3)
    p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2800), rng.normal(-3, 1, 1200)])
    assert abs(quality.class_prior(p, u) - 0.7) < 0.05
    good, rest = quality.risk(p[:5], u[:5], 0.7)
    assert good == pytest.approx(0.7 * sum(np.log(1 + np.exp(-x)) for x in p[:5]) / 5)
    assert rest == pytest.approx(sum(np.log(1 + np.exp(x)) for x in u[:5]) / 5 - 0.7 * sum(np.log(1 + np.exp(x)) for x in p[:5]) / 5)


def test_fit_finds_the_mixture():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0, 1, (3000, 2)), rng.normal((3, -2), 1, (600, 2))
    x = np.concatenate([good[:1500], bad])
    bins = quality.Bins(good[1500:], x)
    p, u, size = bins(good[1500:]), bins(x), int(bins.starts[-1]) + 1
    w = quality.fit(p, u, 1500 / 2100, size, steps=600)
    s = quality._logit(w, u)
    assert (s[:1500] > 0).mean() > 0.95 and (s[1500:] < 0).mean() > 0.8


def quality_rows(spark, n=600):
    rng = np.random.default_rng(9)
    words = ["the", "house", "by", "a", "lake", "Was", "green.", "and", "we", "saw", "it", "often", "though"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = list(rng.choice(words, rng.integers(5, 200)))
        rows.append((i, "\n".join(" ".join(x + ("!!$$" if bad else "") for x in w[k:k + 12]) for k in range(0, len(w), 12)), "x", "y"))
        if i % 2:
            labels.append((i, 0 if bad else 1))
    schema = "doc_id long, text string, score string, predicted string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_quality_learns_and_leaves_held_out_labels(spark):
    df, labels, rows = quality_rows(spark)
    got = {r.doc_id: r for r in quality.quality(df, labels).collect()}
    right = [got[i].predicted == (i % 5 != 0) for i in range(len(rows))]
    assert len(got) == len(rows) and np.mean(right) > 0.95
    # labels of 0, and all labels of the held-out fifth, change nothing
    odd = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))).where((F.col("quality") == 1) | quality.held_out())
    assert {r.doc_id: r.score for r in quality.quality(df, odd).collect()} == {i: r.score for i, r in got.items()}


def test_quality_takes_odd_rows(spark):
    df, labels, _ = quality_rows(spark)
    odd = docs(spark)
    mixed = odd.unionByName(df.select("doc_id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema if f.name not in ("doc_id", "text")]))
    more = labels.unionByName(spark.createDataFrame([(None, 1), (6, 0), (6, 1), (12, None)], labels.schema))
    out = quality.quality(mixed, more)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + df.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.secrets in ("d", None) for r in rows)
    empty = [r.score for r in rows if not (r.text or "")]
    assert len(empty) == 2 and empty[0] == empty[1]
    assert quality.quality(none(spark), more).collect() == []
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {quality.NO_MODEL}
