"""Personal data and secrets: exact patterns by brute force, odd rows, learned spans."""

import random
import re

from pyspark.sql import functions as F

from pulsewatch.llm import pii, secrets_crf

from .helpers import TEXTS, docs, none

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HEX = re.compile(r"[0-9a-f]+")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(g):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(g))) % 10 == 0


def personal(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def secret(t):
    out = [(m.start(), 0, m.end()) for m in secrets_crf.ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m.group()) >= 32]
    return sorted(out)


def fuzz(parts, n, seed):
    rng = random.Random(seed)
    return [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for k in range(n)]


PARTS = ["a@b.c", "@", ".", "_x", "1", "12.3.4.5", "256", " ", "-", "+", "(", ")", "4111111111111111", "ü", "🙂", "0", "+1 (482) 555-7163", "..", "a"]


def test_personal_data_equals_brute_force(spark):
    texts = TEXTS + fuzz(PARTS, 1500, 7) + [(7, "1" * 60_000), (8, "1.2." * 9000), (10, "a." * 20_000 + "@x.y"), (11, "+1" + "(" * 9000)]
    want = sorted((str(i), tuple(personal(t or ""))) for i, t in texts)
    got = pii.find_personal_data(docs(spark, texts)).collect()
    assert sorted((str(r.doc_id), tuple((s.start, s.kind_at, s.end) for s in r.base)) for r in got) == want
    assert pii.find_personal_data(none(spark)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(k, f"words here customer mailbox user{k}@mail.example.com and more") for k in range(5)]
    texts = seeds + [(50, "other words customer mailbox user77-at-mail done"), (51, "other words random thing item77 done")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(docs(spark, texts)).collect()}
    at = texts[5][1].index("user77")
    assert got[50] == [("email", at, at + len("user77-at-mail"))]
    assert got[51] == [] and all(len(got[k]) == 1 for k in range(5))


def test_identifiers_with_contexts_of_their_own_and_over_two_hops(spark):
    seeds = [("customer mailbox", f"u{k}@x.example", "email") for k in range(30)]
    ids = [("customer mailbox", f"id{k}", None) for k in range(4)]
    alone = [(f"only here{k}", "id0", None) for k in range(5)] + [("ticket number", "id0", None)]
    others = [("ticket number", f"t{k}", None) for k in range(9)]
    hop = [("second list", f"id{k}", None) for k in range(4)] + [("second list", "far1", None), ("third list", "far1", None)]
    rows = spark.createDataFrame(seeds + ids + alone + others + hop, "pattern string, found string, kind string")
    got = {tuple(r) for r in pii.bootstrap(rows).collect()}
    assert got == {("customer mailbox", f"id{k}", "email") for k in range(4)} | {("second list", f"id{k}", "email") for k in range(4)} \
        | {("second list", "far1", "email")}


def test_contexts_across_signs_and_long_words(spark):
    forms = ["mailbox <{}>", 'field "{}"', "see:\t({})", "key x={}", "a " + "w" * 400 + "  \n {}", "w" * 400 + " to {}", "{} alone", "two\x0bwords [{}]"]
    rows = [(k, "the " + f.format(f"user{k}@mail.example.com") + " end") for k, f in enumerate(forms)]
    rows += [(20 + k, "our mailbox <user%d@mail.example.com>" % k) for k in range(6)] + [(40, "and our mailbox <user77-at-mail> now"), (41, "our mailbox: user78-at-mail")]
    df = docs(spark, rows)
    mentions = pii.with_contexts(pii.with_base(df, "text"), "text").select("doc_id", "text", F.explode("mentions").alias("m")).select("doc_id", "text", "m.*").collect()

    def plain(before):
        bare = before.translate(str.maketrans("\t\n\x0b\f\r", "     ")).rstrip(" " + pii.OPENERS)
        words = [w for w in bare.split(" ") if w]
        return " ".join(words[-2:]).lower() if len(words) > 1 and len(bare) < len(before) else None

    assert len([m for m in mentions if m.kind == "email"]) == 14
    for m in mentions:
        assert m.pattern == plain(m.text[:m.start]) and m.text[m.start:m.end] == m.found, m
    got = {r.doc_id: [(x.kind, x.found) for x in r.spans] for r in pii.find_personal_data(df).collect()}
    assert got[40] == [("email", "user77-at-mail")] and got[41] == [("email", "user78-at-mail")]


def test_secrets_equal_brute_force(spark):
    parts = ["password", "=", ":", " ", "\"", "'", "API_KEY", "token", "abcdef0123456789" * 2, "AKIA", "ABCDEFGH1234", "x", "ſecret", "é", "deadbeef"]
    texts = TEXTS + fuzz(parts, 1500, 9)
    got = secrets_crf.find_secrets(docs(spark, texts), model=({}, __import__("numpy").zeros((3, 3)))).collect()
    kinds = secrets_crf.KINDS
    assert sorted((str(r.doc_id), tuple((s.start, kinds.index(s.kind), s.end) for s in r.secrets)) for r in got) == \
        sorted((str(i), tuple(secret(t or ""))) for i, t in texts)
    assert secrets_crf.find_secrets(none(spark)).count() == 0


def test_field_learns_and_viterbi_is_exact(spark):
    import itertools

    import numpy as np
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("abcdef0123456789ghijk") for _ in range(20))
    texts = [f"some words here password={key()}1a9 and then {rng.randrange(10**6)} more words" for _ in range(200)]
    unary, trans = secrets_crf.learn([w for t in texts for w in secrets_crf.training_windows(t)])
    tagger = secrets_crf.Tagger(unary, trans)
    new = 'some words here auth = "a8dk39fk2lq09dkfj7h1" and then 77 more'
    found = [new[a:b] for a, b in tagger.spans(new)]
    assert any("a8dk39fk2lq09dkfj7h1" in f for f in found)
    assert tagger.spans("plain words with 1234567890 and 10.0.0.1 in it") == []
    score = np.random.default_rng(1).normal(size=(6, 3))
    best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(score[i, t] for i, t in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])))
    assert tuple(tagger.viterbi(score, False, False)) == best


def test_copies_do_not_change_the_field(spark):
    import numpy as np
    rng = random.Random(11)
    words = ["alpha", "beta=", "token", "\"q\"", "17", "x9", "(", "name:", "Z", "10.0.0.1"]
    some = [(k, " ".join([*rng.choices(words, k=rng.randrange(4, 20)), "password=" + "".join(rng.choices("abcdef0123456789XY", k=rng.randrange(8, 40))),
                          *rng.choices(words, k=rng.randrange(4, 20))])) for k in range(150)]
    for hot in (some[0][1], some[1][1], some[2][1]):
        copies = [(1000 + k, hot) for k in range(200)]
        for bounds in ({"max_docs": 50, "max_windows": 40}, {"max_docs": 1000, "max_windows": 40}):
            one, two = secrets_crf.train(docs(spark, some), **bounds), secrets_crf.train(docs(spark, some + copies), **bounds)
            assert one[0].keys() == two[0].keys() and all((one[0][f] == two[0][f]).all() for f in one[0])
            assert (one[1] == two[1]).all() and not np.allclose(one[1], 0)


def test_mask(spark):
    rows = docs(spark, [(1, "a password=12345678x b"), (2, None), (3, "clean")])
    found = secrets_crf.find_secrets(rows, model=({}, __import__("numpy").zeros((3, 3))), out_col="s")
    got = {r.doc_id: r.m for r in found.withColumn("m", secrets_crf.mask("text", "s")).collect()}
    assert got == {1: "a [SECRET] b", 2: None, 3: "clean"}
