"""BPE and token counts against the library; odd rows; round trips."""

import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pulsewatch.llm import bpe, token_count

from .helpers import TEXTS, docs, none

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
PARTS = list("aB'sTtéΣσ \n\t\r0123Ⅷ²½中文🙂_-.,!?<|>\x1c\x85\xa0") + ["<|endoftext|>", "<|startoftext|>", " the", "'ll", "don't", "İ", "  "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [t or "" for _, t in TEXTS] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["ab" * 2000, "é" * 999]


def test_ids_and_text_equal_the_library(texts):
    lib, own = Tokenizer.from_file(WORD), bpe.WordTokenizer(WORD)
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        n, ids_text, decoded, got = own.columns(t, ("n_tokens", "ids_text", "decoded", "ids"))
        assert (n, list(got), ids_text) == (len(ids), ids, " ".join(map(str, ids)))
        assert own.encode(t) == ids
        assert decoded == own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_merge_takes_the_leftmost_lowest_rank():
    ranks = {1 << 20 | 1: 0, 2 << 20 | 1: 1}  # (1,1) -> 2, (2,1) -> 3
    assert bpe.merge([1] * 5, ranks, [2, 3]) == [2, 3]
    assert bpe.merge([1], ranks, [2, 3]) == [1] and bpe.merge([], ranks, [2, 3]) == []


def test_counts_equal_the_library(texts):
    lib, own = Tokenizer.from_file(BYTE), token_count.TokenCounter(BYTE)
    assert [own.count(t) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert {" the", "the"} <= own.whole


def test_odd_rows(spark):
    lib = Tokenizer.from_file(WORD)
    want = ("n_tokens", "ids", "ids_text", "decoded")
    got = bpe.decode(bpe.encode(docs(spark), WORD, want=want), WORD, out_col="again").collect()
    expected = sorted((str(i), tuple(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == expected
    assert all(r.decoded == r.again for r in got)
    counts = {(r.doc_id, r.n_bytes, r.over_limit) for r in token_count.count_tokens(docs(spark), BYTE).collect()}
    assert {(i, len((t or "").encode())) for i, t in TEXTS} == {c[:2] for c in counts}
    assert (4, len(TEXTS[3][1]), True) in counts and (2, 0, False) in counts
    assert bpe.encode(none(spark), WORD).count() == 0 == token_count.count_tokens(none(spark), BYTE).count()


def test_query_digests(spark):
    from pulsewatch.llm.queries import QUERIES
    lib = Tokenizer.from_file(WORD)
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op1_bpe"](spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_short_words_merge_as_long_ones_do(monkeypatch):
    """The scan for short words and the tree give the same ids."""
    rng, own = random.Random(5), bpe.WordTokenizer(WORD)
    words = ["".join(rng.choice("aabeinorst'éΣ中🙂0") for _ in range(rng.randrange(1, bpe.SHORT + 8))) for _ in range(2000)]
    scanned = [own.merge_text(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 1)
    assert [own.merge_text(w) for w in words] == scanned
    assert bpe.merge_short([1] * 5, {1 << 20 | 1: 0, 2 << 20 | 1: 1}, [2, 3]) == [2, 3]
