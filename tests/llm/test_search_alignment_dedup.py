"""Ranked search, token alignment and MinHash near-dedup against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lexical_search, minhash_dedup, packing, token_alignment
from sparkloom.llm.common import table

from . import brute
from .test_llm import odd_docs, words  # noqa: F401

PARTS = [" ", "  ", "   ", "\t", "\n", "\r", "\xa0", "　", " ", " ", "\x85", "\x1c", "​", "﻿", "é", "é", "ñ", "İ"]
PARTS += ["the", " the", "The", "'s", "don't", "123", ".", ",", "...", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "▁", "日本", "こん", "😀", "\x00", "ß", "ﬁ", "a", " a", "ación", "שלום", "#"]
LETTERS = list("İıßΣςσǅﬁﬀŉſKÅ.,!?;·é1²٣_-ª ᾳᾼab \n") + ["̇", "́", "̈", "़", "क़", "יִ", "ﬡ", "한", "한", ";", "'s", "'T", "’s", "<|", "<|endoftext|>", "ა", "Ა", "İ.", "­", "\x85", "the", "😀"]


def mixed(rng, parts, n, most):
    return ["".join(rng.choices(parts, k=rng.randint(0, most))) for _ in range(n)]


# ---------------------------------------------------------------- search


def found(frame):
    out: dict = {}
    for r in sorted(frame.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def test_search_brute_force(spark, monkeypatch):
    """Ties at the cut, repeated terms, odd characters; shards of a few documents and several blocks of queries."""
    rng = random.Random(4)
    vocabulary = ["la", "LA", "Ñandú", "x1", "d'or", "été", "日本語", "the", "the", "a_b", "co-op", "zeta"]
    docs = [(i, rng.choice([" ", "--", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 7)))) for i in range(300)]
    docs += [(400 + i, "tie tie zeta") for i in range(40)] + [(500, None), (501, ""), (502, " .,;")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 5)))) for i in range(30)] + [(100, "tie"), (101, None), (102, "TIE tie absent")]
    frame, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string")
    expected = {i: x for i, x in brute.ranked(docs, items, 20).items() if x}
    assert found(lexical_search.ranked_search(frame, queries)) == expected
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 40)
    monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", 10)
    monkeypatch.setattr("sparkloom.llm.textops.SLICE_BYTES", 64)
    assert found(lexical_search.ranked_search(frame, queries)) == expected


def test_search_on_odd_texts(spark, odd_docs):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "w1 w2 w3"), (2, "ünï one A"), (None, "without")]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("terms", "Rank", "docs", "id", "no")})
    expected = {i: x for i, x in brute.ranked(rows, items, 20).items() if x}
    assert found(lexical_search.ranked_search(clash, queries.unionByName(queries))) == expected  # a row that repeats is answered once
    assert lexical_search.ranked_search(odd_docs.limit(0), queries).count() == 0
    assert lexical_search.ranked_search(odd_docs, queries.limit(0)).count() == 0


def test_index_is_kept_and_opened(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c")], "doc_id long, text string")
    lexical_search.build_index(docs, f"{tmp_path}/index")
    index = lexical_search.Index.open(spark, f"{tmp_path}/index")
    assert (index.n_docs, index.n_terms) == (2, 5)
    queries = spark.createDataFrame([("q", "C")], "rank string, text string")
    got = lexical_search.search(index, queries, id_col="rank").collect()
    assert [(r["query_rank"], r["rank"], r["doc_id"]) for r in got] == [("q", 1, 2)]


def test_best_is_safe_with_ties():
    rng = np.random.RandomState(3)
    for _ in range(200):
        score, k = rng.randint(0, 5, 30), int(rng.randint(1, 32))
        ids = rng.permutation(30)
        expected = sorted(range(30), key=lambda i: (-score[i], ids[i]))[:k]
        assert sorted(lexical_search.best(score, ids, k).tolist()) == sorted(expected)


# ---------------------------------------------------------------- alignment


def test_alignment_brute_force(spark, monkeypatch):
    """Odd characters, special tokens as text, texts that don't come back; small chunks and a cache that is emptied."""
    rows = list(enumerate(mixed(random.Random(8), PARTS, 700, 20))) + [(900, None), (901, ""), (902, " "), (903, "x  "), (904, "a" * 5000), (904, "the the"), (None, "the")]
    expected = sorted(map(repr, brute.Tokenizers(*token_alignment.default_tokenizers()).align(rows)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(repr(tuple(r)) for r in token_alignment.align(frame, *token_alignment.default_tokenizers()).documents.collect()) == expected
    coder = token_alignment.Aligner(*token_alignment.default_tokenizers())
    monkeypatch.setattr(token_alignment, "UNITS", 0)
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 500)
    monkeypatch.setattr(token_alignment, "aligner", lambda *paths: coder)
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(token_alignment, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    monkeypatch.setattr(token_alignment, "slices", lambda column: __import__("sparkloom.llm.textops", fromlist=["slices"]).slices(column, 300))
    digests = [d for out in token_alignment._chunks("", "")([batch]) for c in out["digests"].to_pylist() if c for d in c]
    assert digests == [t[-1] for t in brute.Tokenizers(*token_alignment.default_tokenizers()).align(rows)]


def test_alignment_dictionary(spark, odd_docs):  # noqa: F811
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("chunk", "n_a", "Place", "group_key")})
    got = token_alignment.align(clash, *token_alignment.default_tokenizers(), weight="documents")
    docs = {r["doc_id"]: r for r in got.documents.where("doc_id IS NOT NULL").collect()}
    assert docs[0]["n_a"] == docs[1]["n_a"] == 0 and docs[0]["groups_sha256"] == "" and docs[8]["n_groups"] == docs[9]["n_groups"] > 60_000
    groups = got.groups.collect()
    assert sum(g["occurrences"] for g in groups) == got.documents.agg(F.sum("n_groups")).first()[0]
    one = next(g for g in groups if g["documents"] >= 3)
    assert one["occurrences"] >= one["documents"]
    pairs = got.links.groupBy("b_id").agg(F.max("count").alias("top"), F.max(F.when(F.col("best"), F.col("count"))).alias("best")).collect()
    assert all(p["top"] == p["best"] for p in pairs)
    assert token_alignment.align(odd_docs.limit(0), *token_alignment.default_tokenizers()).documents.count() == 0


def test_links_end_together():
    """Tokens of lengths 1, 2 | 3 and 2, 1, 1 | 1, 3."""
    n, size = (lambda *x: np.array(x)), (lambda *x: np.array(x))
    a, b = token_alignment.linked(n(2, 3), size(1, 2, 2, 1, 1), n(1, 2), size(3, 1, 3))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 0), (4, 2)]


# ---------------------------------------------------------------- near duplicates


def edited(rng, base, edits, vocabulary):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return " ".join(out)


def test_minhash_brute_force(spark):
    rng = random.Random(3)
    vocabulary, rows = [f"w{i}" for i in range(400)], []
    for size in [1, 3, 4, 5, 8, 12, 20, 40, 80, 300] * 4:
        base = rng.choices(vocabulary, k=size)
        rows += [(2 * len(rows) + k, edited(rng, base, rng.randint(0, max(1, size // 22)), vocabulary)) for k in range(rng.randint(1, 9))]
    rows = list(dict(rows).items()) + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "a b b a c"), (10_004, "b a a b c")]
    expected = brute.jaccard_components(rows, 4, 80)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(frame).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_minhash_large_group(spark, monkeypatch):
    """One group of near copies whose posting lists take many blocks."""
    monkeypatch.setattr("sparkloom.llm.jaccard_join.BLOCK", 64)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=120)
    rows = [(i, edited(rng, base, rng.randint(1, 9), vocabulary)) for i in range(500)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_components(rows, 4, 80)


def test_minhash_on_odd_texts(odd_docs):  # noqa: F811
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("key", "Sketch", "kept", "component_id", "token")})
    got = minhash_dedup.near_duplicates(clash, carry=["key", "Sketch", "token"]).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 13 and {r["key"] for r in got} == {"x"}
    assert by_id[6]["component_id"] == by_id[7]["component_id"] == 5 and not by_id[6]["kept"]
    assert by_id[9]["component_id"] == 8 and by_id[0]["kept"] and by_id[0]["n_shingles"] == 0 and by_id[None]["kept"]
    assert minhash_dedup.near_duplicates(odd_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(clash, carry=["component_id"])


def test_match_threshold():
    """The threshold is missed with the probability stated, and one more match would be missed oftener."""
    rng = np.random.RandomState(1)
    t = minhash_dedup.match_threshold(64, 0.8, 0.01)
    missed = [(rng.binomial(64, 0.8, 200_000) < x).mean() for x in (t, t + 1)]
    assert missed[0] <= 0.011 and missed[1] >= 0.009


def test_signatures_estimate_similarity():
    rng = np.random.RandomState(2)
    tokens = rng.randint(0, 1 << 62, 3000).astype(np.uint64)
    same = [(minhash_dedup.signature(np.sort(tokens[:2000])) == minhash_dedup.signature(np.sort(tokens[d : 2000 + d]))).mean() for d in (0, 100, 500, 1000)]
    assert same[0] == 1 and all(abs(s - (2000 - d) / (2000 + d)) < 0.2 for s, d in zip(same, (0, 100, 500, 1000), strict=True))


# ---------------------------------------------------------------- packing


def test_packing_ids_of_odd_letters():
    """Letters whose composed or lower-case form is a letter and a mark, and everything next to them."""
    from tokenizers import Tokenizer

    from sparkloom.llm.textops import slices

    coder, model = packing.Encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    texts = mixed(random.Random(6), LETTERS, 3000, 25) + ["İ.", "İ. Yılmaz", "क़.", "ΟΔΟΣ. ὈΔΥΣΣΕΎΣ,"]
    for part in slices(pa.array(texts)):
        ids, edges = coder.encode(part)
        for i in range(len(part)):
            assert ids[edges[i] : edges[i + 1]].tolist() == [*model.encode(part.text(i), add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_token_alignment", "op13_minhash_dedup"])
def test_new_queries(spark, folder, name):
    from sparkloom.llm import registry

    docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    got = registry.QUERIES[name](spark, folder)
    if name == "op11_lexical_search":
        items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
        assert found(got) == {i: x for i, x in brute.ranked(docs, items, 20).items() if x}
    elif name == "op12_token_alignment":
        short = [(i, t) for i, t in docs if len(t or "") < 300]
        expected = {r[0]: (r[1], r[2], r[3], r[4], r[7]) for r in brute.Tokenizers(*token_alignment.default_tokenizers()).align(short)}
        rows = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in got.collect()}
        assert len(rows) == len(docs) and {i: rows[i] for i in expected} == expected
    else:
        expected = brute.jaccard_components(docs, 4, 80)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == expected
