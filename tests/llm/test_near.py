"""Near copies, fingerprints, neighbours: brute force on small tables."""

import itertools
import random

import numpy as np

from pulsewatch.llm import ann, simhash, spotsigs
from pulsewatch.llm.components import connected_components

from .helpers import TEXTS, docs, none


def classes(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in linked:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(900, k) for k in range(700, 800)] + [(5, 5), (999, 999)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    group = classes(1000, pairs)
    for node in {x for p in pairs for x in p}:
        assert got[node] == min(x for x in {y for p in pairs for y in p} if group[x] == group[node])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _simple_simhash(text, k):
    import xxhash
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_bits():
    for _, t in TEXTS:
        if len(t or "") < 20_000:
            assert simhash.simhash(t or "", 4) % (1 << 64) == _simple_simhash(t or "", 4)


def linked_points(spark, values, distance=4):
    points = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    edges = simhash.link(points, distance)
    pairs = [(r.a, r.b) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= distance or ((a ^ b) % (1 << 64)).bit_count() <= distance for a, b in pairs)
    at = {simhash.signed(v): i for i, v in enumerate(values)}
    return classes(len(values), [(at[a], at[b]) for a, b in pairs])


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(400)}  # a dense ball: the midpoint way
    chain = [rng.getrandbits(64)]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    values = sorted(near | set(chain) | {rng.getrandbits(64) for _ in range(300)})
    want = classes(len(values), [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 4])
    got = linked_points(spark, values)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(3)
    bits = rng.random((500, 64)) < rng.random(64)
    plan = simhash.allocate(500, (bits.T.astype(int) @ bits.astype(int)), 4)
    masks = [m for m, _ in plan]
    assert all(a & b == 0 for a, b in itertools.combinations(masks, 2))
    for _ in range(3000):  # any flip of at most four bits is within the threshold of some group
        flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any((flip & m).bit_count() <= t for m, t in plan)


def test_near_duplicates_odd_rows(spark):
    rows = simhash.near_duplicates(docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[6] == 1 and by[2] == by[3] == by[9007199254740993] == 2 and by[None] is None
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_spotsigs_against_plain_python(spark):
    import re
    stop = set(spotsigs.ANCHORS)

    def plain(t):
        words = [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
        content = [w for w in words if w not in stop]
        out, r = set(), 0
        for p, w in enumerate(words):
            if w in stop:
                if p - r < len(content):
                    out.add((w, *content[p - r:p - r + 2]))
                r += 1
        return out
    a = "The cat sat on the mat with a hat and the dog ran to the park by the lake."
    b = "The cat sat on the mat with a hat and the dog ran to the shop by the lake."
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    from pyspark.sql import functions as F
    rows = spotsigs.with_signatures(spotsigs.with_signatures(rows, F.col("a"), "sa"), F.col("b"), "sb")
    r = rows.select(F.size("sa").alias("na"), spotsigs.likeness("sa", "sb").alias("j"), spotsigs.likeness("sa", "sb", 0.99).alias("kept")).first()
    assert r.na == len(plain(a))
    assert abs(r.j - len(plain(a) & plain(b)) / len(plain(a) | plain(b))) < 1e-12


def test_next_rows(spark):
    texts = TEXTS + [(k, f"text number {k}") for k in range(1000, 5000, 37)]
    got = spotsigs.with_next(docs(spark, texts)).collect()
    order = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is None, -(x[0] or 0), [-ord(c) for c in x[1][:50]]))
    want = sorted((str(i), t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert sorted((str(r.id), r.text, r.next_text) for r in got) == want
    assert spotsigs.with_next(none(spark)).count() == 0
    one = spotsigs.with_next(docs(spark, [(5, "alone here")])).first()
    assert one.next_text == "alone here"


def test_spotsigs_classes(spark):
    base = " ".join(f"the cat{k} of dog{k} and bird{k}" for k in range(30))
    texts = [(1, base), (2, base), (3, base + " with the moon"), (4, "an other text about the moon and a star in the sky"), (None, base), (7, None), (8, "")]
    got = {r.doc_id: r.class_id for r in spotsigs.near_duplicates(docs(spark, texts)).collect()}
    assert got[1] == got[2] == got[3] == got[None] == 1 and got[4] == 4 and got[7] == got[8] == 7
    assert spotsigs.near_duplicates(none(spark)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 16))
    x = (centres[rng.integers(0, 8, 900)] + 0.7 * rng.normal(size=(900, 16)))
    x[100:400] = x[100]  # a vector that a third of the rows share
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    rows += [(2000, None, "c"), (2001, [0.0] * 16, "c"), (2002, [float("nan")] + [1.0] * 15, "c"), (2003, [None] + [1.0] * 15, "c"), (2004, [1.0] * 3, "c"), (None, [1.0] * 16, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), block=256, query_block=8).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hit += len({r.vec_id for r in mine} & set(want.tolist()))
    assert hit >= 0.9 * 5 * 18 and len(got) == 90
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 150), key=lambda r: r.rank)] == [100, 101, 102, 103, 104]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.rank) for r in ann.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1)]


def test_neighbours_of_every_length_and_size(spark):
    rng = np.random.default_rng(4)
    vec = {i: (rng.normal(size=2 if i % 3 else 3) * 10.0 ** rng.integers(-3, 3)).tolist() for i in range(1, 400)}
    vec |= {1000: [1e200, 1e200], 1001: [1.0, 1.0], 1050: [1e-200, 1e-200, 1e-200], 1051: [3e250, 3e250, 3e250], 1100: [5.0]}
    rows = [(i, v) for i, v in vec.items()] + [(50, [-1.0, 0.5])]  # one id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), block=64, query_block=4, pivots=16, prefix=8).collect()

    def cos(a, b):
        a, b = [np.array(x) / np.abs(x).max() for x in (a, b)]
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    for q in [i for i in vec if i % 50 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        asked = [v for i, v in rows if i == q]
        best = {}
        for i, v in rows:
            for a in asked:
                if i != q and len(v) == len(a):
                    best[i] = max(best.get(i, -2), cos(a, v))
        want = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        assert [r.rank for r in mine] == list(range(1, len(want) + 1))
        for r, (i, s) in zip(mine, want):
            assert abs(r.score - best[r.vec_id]) < 1e-12 and abs(r.score - s) < 1e-3
    assert {(r.query_id, r.vec_id): round(r.score, 12) for r in got}[(1050, 1051)] == 1.0 and not [r for r in got if r.query_id == 1100]
