"""The ten operators and the pipeline: brute force, round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import (
    decontaminate,
    jaccard_join,
    language_crf,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    registry,
    suffix_dedup,
    toxicity,
    url_filter,
)
from sparkloom.llm.common import table

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null, empty, blank, short, repeated and very long texts, a null id, and columns whose names clash."""
    rng = random.Random(1)
    long = " ".join(words(rng, 60_000))
    texts = [None, "", "   \n\t", "one", "Ünï cödé 日本語 text", "a b c d e", "a b c d e", "A B C D E", long, long, "x" * 3000]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "n") for i, t in enumerate(texts)]
    rows.append((3, "one", "en", "s", 3, 0.5, "n"))
    rows.append((None, "without id", None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA + ", score double, component string")


@pytest.fixture(scope="module")
def docs(spark, folder):
    return table(spark, folder, "documents")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.SQL[name])


def test_quality_rules_on_odd_texts(odd_docs):
    got = quality_rules.quality_rules(odd_docs, clean_col="clean").collect()
    assert len(got) == 13 and not any(r["kept"] for r in got if not (r["text"] or "").strip())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["n_words"] == 4 and by_id[4]["word_chars"] == 14
    assert by_id[8]["n_words"] == 60_000 and by_id[None]["n_words"] == 2


def test_quality_rules_clean_lines(spark):
    rng = random.Random(2)
    body = "\n".join(" ".join(words(rng, 6, 5000)) + "." for _ in range(20))
    text = "Home | News | Login | Help\n" + body + "\nsubscribe to our letter"
    got = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string"), clean_col="clean").first()
    assert got["kept"] and got["clean"] == body


def test_jaccard_join_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for base in range(60):
        original = words(rng, rng.choice([1, 4, 5, 8, 12, 16, 20, 60, 200]), 50 if base % 3 else 5000)
        rows.append(" ".join(original))
        for _ in range(rng.randrange(5)):
            copy = list(original)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(1000)}"
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rows = [(i * 3, t) for i, t in enumerate(rows)] + [(9991, None), (9992, "")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard_components(rows)


def test_jaccard_join_large_group(spark, monkeypatch):
    """Near copies spread over several blocks of a list."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(5)
    base = words(rng, 120, 5000)
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(120)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard_components(rows)


def test_jaccard_join_lists_whose_keys_nearly_clash(monkeypatch):
    """An unrelated set whose key differs in its low bits only takes no pair from a list of subsets."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["one", "two", "three"]})
    sets = sorted(jaccard_join.set_key(t) for _, t in jaccard_join._sets(batch))
    near = lambda tokens: 0x1234567800000000 + int(jaccard_join.set_key(tokens) != sets[0])
    monkeypatch.setattr(jaccard_join, "list_keys", lambda t, *_: (np.array([near(t)], np.uint64), np.zeros(1, np.uint8)))
    shared = SimpleNamespace(value=(np.empty(0, np.uint64), np.empty(0, np.int64)))
    lists = jaccard_join._lists(jaccard_join._index(shared, 14, 1)([batch]))
    assert [(r["a"], r["b"]) for b in lists for r in b.to_pylist()] == [tuple(sets[1:])]


def test_jaccard_join_without_ids(spark):
    base = words(random.Random(21), 100, 5000)
    near = lambda k: " ".join([*base[:k], "z", *base[k + 1 :]])
    rows = [(None, near(10)), (None, near(50)), (7, near(90)), (None, "quite another text of seven words"), (None, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["component_id"] is None, r["n_shingles"]) for r in got) == [(False, 96)] * 3 + [(True, 0), (True, 2)]


def test_jaccard_join_on_odd_texts(odd_docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(odd_docs).collect()]
    assert len(got) == 13
    assert {g for g in got if g[0] in (0, 1, 2)} == {(0, 0, 0), (1, 0, 1), (2, 0, 2)}
    assert {g[2] for g in got if g[0] in (5, 6, 7)} == {5} and got.count((3, 1, 3)) == 2


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("chunk", [1 << 10, 4 << 20])
def test_suffix_dedup_brute_force(spark, keep, chunk):
    rng = random.Random(7)
    passages = [" ".join(words(rng, 30)) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = [" ".join(words(rng, rng.randrange(30))) for _ in range(3)]
        parts.insert(1, rng.choice(passages)[rng.randrange(5) :])
        texts.append(" é ".join(parts))
    texts += ["ab" * 200, "", None, texts[0], texts[0], " ".join([*words(rng, 15)] * 3), "\n".join(words(rng, 25))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = suffix_dedup.suffix_dedup(frame, keep=keep, length=60, gram=20, chunk_bytes=chunk).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got] == brute.suffix_dedup(texts, 60, keep)
    for passage in (12, 20):
        frame_got = suffix_dedup.suffix_dedup(frame, keep=keep, length=60, gram=20, chunk_bytes=chunk, passage=passage).orderBy("doc_id").collect()
        assert [r["n_repeat_words"] for r in frame_got] == brute.repeated_words(texts, passage)


def test_suffix_dedup_query(spark, folder, docs):
    got = {r["doc_id"]: tuple(r)[1:5] for r in registry.QUERIES["op8_suffix_dedup"](spark, folder).collect()}
    rows = docs.select("doc_id", "text").collect()
    wanted = brute.suffix_dedup([r["text"] for r in rows], 400, "none")
    assert got == {r["doc_id"]: w for r, w in zip(rows, wanted, strict=True)}


def test_suffix_dedup_cuts_long_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    rng = random.Random(9)
    shared = " ".join(words(rng, 200))
    for text in (" ".join(words(rng, 300)) + shared, shared + " ".join(words(rng, 50))):
        cut = suffix_dedup.segments(pa.array([text]), suffix_dedup.Unit(False, 60, 20))
        assert [int(s["first"]) for s in cut[1:]] == [int(s["last"]) + 1 for s in cut[:-1]]
        assert (int(cut[0]["first"]), int(cut[-1]["last"])) == (0, len(text) - 60)
        part = next(iter(suffix_dedup.slices(pa.array([text]))))
        monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 20)
        whole = suffix_dedup._word_hashes(part)
        monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
        assert all(np.array_equal(a, b) for a, b in zip(suffix_dedup._word_hashes(part), whole, strict=True))


def test_packing_round_trip(spark, docs, odd_docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    model = Tokenizer.from_file(path)
    for frame in (docs.select("doc_id", "text"), odd_docs.where("doc_id < 9 AND doc_id <> 3").select("doc_id", "text")):
        pieces: dict = {}
        sequences: dict = {}
        for r in packing.pack(frame, path, with_ids=True).collect():
            pieces.setdefault(r["doc_id"], []).append(r)
            sequences.setdefault(r["sequence_id"], []).append(r)
        for d in frame.collect():
            ids = model.encode(d["text"] or "", add_special_tokens=False).ids + [packing.END_ID]
            own = sorted(pieces[d["doc_id"]], key=lambda r: r["start"])
            assert [i for r in own for i in r["ids"]] == ids
            assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
        assert all(len(s) == 1 and s[0]["offset"] == 0 and s[0]["length"] & (s[0]["length"] - 1) == 0 for s in sequences.values())


def test_personal_data_base_and_redaction(spark, docs, odd_docs):
    made = [
        (1, "mail a.b@c-d.org. or x@y, 10.0.0.1 1.2.3.4.5 999.1.1.1 +49 (30) 1234-567 4111 1111 1111 1111 4111111111111112"),
        (2, "password=32bb02aa3b580bf8ab, call (555) 123-4567, jane [at] site [dot] org, Dr. Jane Roe"),
        (3, "@@a@b.c@d.e 4111-1111-1111-1111 +1"),
    ]
    frame = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).unionByName(odd_docs.select("doc_id", "text"))
    model = pii.train(frame)
    for r in pii.personal_data(frame, model, redacted_col="clean").collect():
        spans = brute.personal_data(r["text"])
        assert [r[f"n_{k}"] for k in spans] == [len(x) for x in spans.values()], r["text"]
        base = ",".join(f"{k}:{a}:{b}" for k, own in spans.items() for a, b in own)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert not r["spans"] or r["clean"] != r["text"]


def test_personal_data_added_spans(spark):
    """Names, secrets, spelled-out addresses and national numbers among look-alikes: what is added is right, and most is added."""
    rng = random.Random(41)
    wrong, right, rows = set(), set(), []
    for i in range(400):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        made = [
            (f"api_key = {token} ok", token, True), (f"password: \"{token}\" set", token, True), ("Signed by Dr. Jane Rowe today", "Jane Rowe", True),
            (f"call ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} now", None, True), ("ratio:abcdefgh words", "abcdefgh", False),
            ("see key=configuration file", "configuration", False), ("number 2123465659789240 here", "2123465659789240", False),
        ]
        text, span, good = rng.choice(made)
        span = span or text[text.index("(") : text.index(" now")]
        lead = " ".join(words(rng, 12)) + " "
        rows.append((i, lead + text))
        begin = len(lead) + text.index(span)
        (right if good else wrong).add((i, begin, begin + len(span)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(frame, pii.train(frame)).collect()
    got = {(r["doc_id"], int(a), int(b)) for r in found for s in r["spans"].split(",") if s for _, a, b in [s.split(":")]}
    assert len(got & right) >= 0.95 * len(right) and len(got - right) <= 0.05 * len(got) and not got & wrong


def test_decontamination(spark, odd_docs):
    rng = random.Random(11)
    item = " ".join(words(rng, 60, 5000))
    edited = item.replace(item[40], "#", 1)
    filler = " ".join(words(rng, 80, 5000))
    rows = [(1, f"{filler} {item} {filler}"), (2, f"{filler} {edited.upper()}"), (3, filler), (4, item[:60] + filler), (5, None), (6, item[100:200])]
    items = spark.createDataFrame([(7, item), (8, None), (9, "ab")], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 7), (2, 7), (6, 7)}
    whole = next(r for r in got if r["doc_id"] == 1)
    assert (whole["start"], whole["end"], whole["edits"]) == (len(filler) + 1, len(filler) + 1 + len(item), 0)
    assert decontaminate.contaminated(odd_docs, items).count() == 0
    assert decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0


def test_decontamination_brute_force(spark):
    """Pieces of items with edits at either end, against the alignment of every piece with every passage."""
    rng = random.Random(15)
    items = [(k, " ".join(words(rng, n, 5000))) for k, n in enumerate((60, 24, 14, 8, 5))]
    rows, near = [], items[0][1]
    for where in ((5, 10, 20), (60, 70, 76), (0, 1, 2, 3), (76, 77, 78, 79), (2, 40, 78), (1, 3, 76, 78)):
        piece = list(near[100:180])
        for at in where:
            piece[at] = "#"
        rows += [(f"{' '.join(words(rng, 12, 5000))} {''.join(piece)} {' '.join(words(rng, 12, 5000))}"), "".join(piece)]
    for _ in range(80):
        text = rng.choice(items)[1]
        at, size = rng.randrange(max(1, len(text) - 90)), rng.randrange(74, 112)
        piece = list(text[at : at + size])
        for _ in range(rng.randrange(7)):
            k = rng.choice([rng.randrange(len(piece)), rng.randrange(25), len(piece) - 1 - rng.randrange(25)]) % len(piece)
            piece[k : k + rng.randrange(2)] = rng.choice(["#", "", "##"])
        rows.append(rng.choice(["", " ".join(words(rng, 9, 5000)) + " "]) + "".join(piece) + rng.choice(["", " " + " ".join(words(rng, 9, 5000))]))
    rows = list(enumerate(rows))
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame, bench).collect()}
    texts, least = dict(rows), set()
    for d, t in rows:
        for i, item in items:
            size = min(len(item), 80)
            if brute.piece_edits(item, t, size) <= size * 4 // 80:
                least.add((d, i))
    assert {k for k in range(12)} <= {d for d, _ in least} and least <= set(got)
    for (d, i), r in got.items():  # what is said of the region holds, and no more edits in proportion
        passage = texts[d][r["start"] : r["end"]]
        assert brute.piece_edits(passage, dict(items)[i], len(passage)) <= r["edits"]
        assert (d, i) in least or r["edits"] <= (len(passage) + r["edits"]) * 4 // 80


def test_decontamination_of_runs_and_repeats():
    """Long runs of a short period, and phrases that repeat in item and text, cost no more than other text."""
    import time

    rng = random.Random(19)
    item = " ".join(words(rng, 20)) + " " * 60 + " ".join(words(rng, 20)) + "-" * 200 + " ".join(words(rng, 10))
    phrase = " ".join(words(rng, 3))
    index = decontaminate.Index.of([0, 1], [item, " ".join([phrase] * 30)])
    begun = time.process_time()
    for text, found in [(" " * 1_000_000, set()), ("-" * 1_000_000, set()), ("ab" * 500_000, set()), (f"x {item} y", {0}), (f"{phrase} " * 2000, {1})]:
        got = [m for part in decontaminate.slices(pa.array([text])) for m in decontaminate.matches(part, index)]
        assert {m[1] for m in got} == found
    assert time.process_time() - begun < 20


def test_decontamination_counts_by_row(spark, monkeypatch):
    """Rows are judged one by one, without an id, over all blocks of the benchmark."""
    rng = random.Random(29)
    items = [(i, " ".join(words(rng, 40, 5000))) for i in range(6)]
    rows = [(1, f"x {items[0][1]} y {items[5][1]}"), (1, "clean text"), (None, items[2][1]), (None, None)]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 400):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = [(r["doc_id"], r["n"]) for r in decontaminate.count_items(frame, bench, "n").collect()]
        assert sorted(got, key=str) == sorted([(1, 2), (1, 0), (None, 1), (None, 0)], key=str)


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(13)
    items = [(i, " ".join(words(rng, 40, 5000))) for i in range(20)]
    rows = [(i, f"before it {t} after it") for i, t in items]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i in range(20)}


def test_empty_tables(spark, folder, odd_docs):
    """Every operator gives an empty table of its columns for an empty table."""
    none = odd_docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([], "url string, bad int")
    made = [
        quality_rules.quality_rules(none, clean_col="clean"), jaccard_join.jaccard_components(none), pii.personal_data(none, pii.train(none)),
        decontaminate.contaminated(none, table(spark, folder, "benchmark")), packing.pack(none, packing.default_tokenizer()),
        suffix_dedup.suffix_dedup(none), url_filter.url_filter(pages, outcomes),
    ]
    for frame in made:
        assert frame.columns and frame.count() == 0


def test_clashing_names(spark, odd_docs):
    """Columns of the input that bear the names of results are replaced or left alone, never mixed up."""
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("component_id", "n_shingles", "start", "length", "n_bytes", "spans", "kept", "group", "n", "key")})
    assert {r["component_id"] for r in jaccard_join.jaccard_components(clash).where("doc_id IN (5, 6, 7)").collect()} == {5}
    assert {r["n_bytes"] for r in suffix_dedup.suffix_dedup(clash).where("doc_id = 10").collect()} == {3000}
    assert packing.pack(clash, packing.default_tokenizer()).where("length > 0").count() > 13
    assert {r["kept"] for r in quality_rules.quality_rules(clash).collect()} <= {True, False}
    assert "x" not in {r["spans"] for r in pii.personal_data(clash, pii.train(clash)).collect()}


@pytest.mark.parametrize("case", [str, str.upper, str.title])
def test_clashing_names_in_any_case(spark, folder, odd_docs, case):
    """Extra columns with the names of results and of helper columns, in any case, crash nothing, and results can be told apart."""
    results = ["kept", "base_failed", "n_bytes", "n_spans", "spans", "base_sha256", "n_email", "lang_pred", "predicted", "sequence_id", "component_id", "group"]
    helpers = ["benchmark_items", "benchmark_items_0", "benchmark_items_of_block", "row_h1", "toxicity", "redacted", "key", "sketch", "small", "token", "count", "chunk"]
    few = odd_docs.where("doc_id IS NULL OR doc_id NOT IN (8, 9)").drop("score", "component")
    clash = few.withColumns({case(c): F.lit("x") for c in results + helpers})
    benchmark = table(spark, folder, "benchmark")
    made = [quality_rules.quality_rules(clash), suffix_dedup.suffix_dedup(clash), pii.personal_data(clash, pii.train(clash)), packing.pack(clash, packing.default_tokenizer())]
    made += [jaccard_join.jaccard_components(clash, carry=[case(c) for c in helpers])]
    for frame in made:
        assert len({c.lower() for c in frame.columns}) == len(frame.columns)
        assert frame.select(*[f"`{c}`" for c in frame.columns]).count() >= 11
    assert decontaminate.contaminated(clash, benchmark).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, clash, folder).columns == clash.columns and stage(spark, clash, folder).count() >= 7


def test_sample_plan_cuts_before_it_shuffles(spark, docs, folder):
    """No more rows than a class has places leave a task, beyond the size up to which windows are cut by themselves."""
    from sparkloom.llm import labelled

    frame = labelled.sample(docs, table(spark, folder, "labels"), "toxic", F.lit(True), 3000)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject(limit=3000") >= 2


def test_samples_are_bounded(spark):
    """An id with many rows takes no more than its class's places, and a huge text none that another could have."""
    from sparkloom.llm import labelled

    rows = [(1, f"copy {i}") for i in range(200)] + [(i, f"text {i}") for i in range(2, 40)] + [(50, "z" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(1, 40), 50]], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", F.lit(True), 10, 16_000).collect()
    count = [sum(r["y"] == y for r in got) for y in (0, 1)]
    assert count == [10, 10] and sum(len(r["text"]) > 100 for r in got) <= 1
    assert len(labelled.sample(docs.unionByName(docs), labels, "quality", F.lit(True), 10, 16_000).collect()) == len(got)
    every = labelled.sample(docs, labels, "quality", F.lit(True), 300, 4000).collect()
    assert len(every) == 238 and max(len(r["text"]) for r in every) < 100
    few = labelled.sample(docs, labels, "quality", F.lit(True), 100, 160).collect()
    assert sum(len(r["text"]) for r in few if r["y"] == 0) <= 160


def marked(spark, n=240):
    """Documents of which every third has marked words, and their labels."""
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(n):
        own = words(rng, 40)
        if i % 3 == 0:
            own[5] = own[20] = "zgrumpfel"
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 3 == 0), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers_learn_and_score_anything(spark, odd_docs, module, label):
    frame, labels = marked(spark)
    learn = F.col("doc_id") < 160
    model = module.train(frame, labels, label, learn)
    got = module.score(frame, model).where("doc_id >= 160").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got]) >= 0.9
    scores = [r["score"] for r in module.score(odd_docs, model).collect()]
    assert len(scores) == 13 and all(0 <= s <= 1 for s in scores)
    blank = module.train(frame, labels.limit(0), label, learn)
    assert {r["score"] for r in module.score(frame.limit(3), blank).collect()} == {0.5}
    assert module.score(frame.limit(0), model).count() == 0


def test_classifier_scores_one_by_one(spark, docs, odd_docs):
    """Scores of whole texts against features counted one by one, with the same model."""
    from sparkloom.llm.textops import PrefixHash

    frame, labels = marked(spark)
    rows = docs.where("length(text) < 4000").select("doc_id", "text").limit(40).unionByName(odd_docs.where("doc_id < 8").select("doc_id", "text"))
    word = lambda w: int(PrefixHash(np.frombuffer(w.encode(), np.uint8)).of(np.array([0]), np.array([len(w.encode())]))[0] >> np.uint64(64 - quality_classifier.BITS))
    toxic = toxicity.train(frame, labels, "toxic", F.lit(True))
    good = quality_classifier.train(frame, labels, "quality", F.lit(True))
    for r in toxicity.score(rows, toxic).collect():
        assert r["score"] == pytest.approx(brute.toxicity_score(r["text"], toxic, toxicity.NGRAMS, toxicity.BITS), abs=1e-5)
    for r in quality_classifier.score(rows, good).collect():
        wanted = brute.quality_score(r["text"], good, word, quality_classifier.NGRAMS, quality_classifier.BITS, quality_classifier.REPEAT_SPAN)
        assert r["score"] == pytest.approx(wanted, abs=1e-4)


def test_a_text_of_megabytes(spark, folder):
    """One text of four megabytes among small ones goes through every operator whole."""
    rng = random.Random(43)
    lines = [" ".join(words(rng, 11, 50_000)) + "." for _ in range(55_000)]
    text = "\n".join(lines)
    item = table(spark, folder, "benchmark").orderBy("item_id").first()
    tail = f"{text}\n{item['text']}\nwrite to some.body@example.org"
    frame = spark.createDataFrame([(1, tail, "en"), (2, "small text of five words", "en"), (3, lines[7] * 30, "en")], "doc_id long, text string, lang string")
    assert len(tail) > 4_000_000
    got = quality_rules.quality_rules(frame).where("doc_id = 1").first()
    assert got["n_words"] == len(tail.split()) and got["kept"]
    assert jaccard_join.jaccard_components(frame).where("doc_id = 1").first()["n_shingles"] > 500_000
    assert {r["doc_id"] for r in decontaminate.contaminated(frame, table(spark, folder, "benchmark")).where(f"item_id = {item['item_id']}").collect()} == {1}
    assert pii.personal_data(frame, pii.train(frame)).where("doc_id = 1").first()["n_email"] == 1
    packed = packing.pack(frame, packing.default_tokenizer()).where("doc_id = 1").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).first()
    assert packed["n"] == packed["all"] > 600_000
    assert suffix_dedup.suffix_dedup(frame, keep="none", clean_col=None).where("doc_id = 1").first()["n_bytes"] == len(tail.encode())
    model, labels = marked(spark)
    for module, label in ((toxicity, "toxic"), (quality_classifier, "quality")):
        assert 0 <= module.score(frame, module.train(model, labels, label, F.lit(True))).where("doc_id = 1").first()["score"] <= 1
    crf = language_crf.train(table(spark, folder, "documents"), F.lit(True), per_language=20)
    assert language_crf.predict(frame, crf).where("doc_id = 1").first()["lang_pred"] in crf.languages


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality_classifier", "quality", 0.9), ("op5_toxicity", "toxic", 0.8)])
def test_classifier_queries(spark, folder, name, label, least):
    got = registry.QUERIES[name](spark, folder)
    held = got.where("held_out").join(table(spark, folder, "labels"), "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least
    assert got.count() == table(spark, folder, "documents").count()


def test_language_query_and_odd_texts(spark, folder, odd_docs):
    got = registry.QUERIES["op10_language_crf"](spark, folder).join(table(spark, folder, "documents"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    model = language_crf.train(table(spark, folder, "documents"), F.lit(True), per_language=20)
    rows = {r["doc_id"]: r for r in language_crf.predict(odd_docs, model).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == "und" and rows[3]["lang_pred"] in model.languages
    empty = language_crf.train(odd_docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_crf.predict(odd_docs, empty).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More languages than any bound on them, the last with the fewest documents; rows of each are bounded."""
    rng = random.Random(25)
    rows = []
    for k in range(80):
        own = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in "bcdfg"]
        rows += [(len(rows) + i, " ".join(rng.choices(own, k=20)), f"l{k:02d}") for i in range(3 if k == 79 else 6)]
    frame = spark.createDataFrame([*rows, (9999, "some text", None)], "doc_id long, text string, lang string")
    model = language_crf.train(frame, F.lit(True), per_language=5)
    assert model.languages == [f"l{k:02d}" for k in range(80)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_crf.predict(frame, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) >= 0.9 and got[rows[-1][0]] == "l79"


def test_language_of_long_texts_only_is_learned(spark, monkeypatch):
    """Texts above a sixteenth of the bytes of a language come last, not never."""
    monkeypatch.setattr(language_crf, "MOST_BYTES", 20_000)
    rows = [(i, " ".join(["lorem ipsum dolor"] * 120), "aa") for i in range(4)] + [(10 + i, "der die das und", "bb") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_crf.train(docs, F.lit(True)).languages) == {"aa", "bb"}


def test_language_of_words_in_mixed_text(spark, odd_docs):
    rng = random.Random(23)
    vocabulary = {"aa": [f"{x}é{y}" for x in "bdgk" for y in "lmn"], "bb": [f"{x}ou{y}" for x in "fpst" for y in "rvz"]}
    learn = [(i, " ".join(rng.choices(vocabulary[lang], k=30)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    model = language_crf.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"), F.lit(True))
    parts = [("aa", 12), ("bb", 15), ("aa", 9)]
    wanted = [(w, lang) for lang, n in parts for w in rng.choices(vocabulary[lang], k=n)]
    text = "12 " + " ".join(w for w, _ in wanted)
    frame = spark.createDataFrame([(1, text, None), (2, "12 34 —", None), (3, None, None), (4, "béll fouv", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_crf.predict(frame, model, words_col="labels").collect()}
    assert [(text[w["start"] : w["end"]], w["lang"]) for w in got[1]["labels"]] == wanted
    assert got[2]["labels"] == got[3]["labels"] == [] and len(got[4]["labels"]) == 2
    # with two languages the document's share follows from the words
    own = [w["probability"] if w["lang"] == "aa" else 1 - w["probability"] for w in got[1]["labels"]]
    assert got[1]["lang_pred"] == "aa" and got[1]["score"] == pytest.approx(sum(own) / len(own))
    assert min(w["probability"] for w in got[1]["labels"]) > 0.5
    assert language_crf.predict(odd_docs, model, words_col="labels").where("size(labels) > 0").count() == 10
    empty = language_crf.train(odd_docs.limit(0), F.lit(True))
    assert language_crf.predict(odd_docs, empty, words_col="labels").where("size(labels) > 0").count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    words_ = language_crf.Words(next(iter(language_crf.text_slices(pa.array(["a b c\nd e"])))))
    rng = np.random.RandomState(0)
    scores, move, first = rng.randn(5, 2).astype(np.float32), rng.randn(2, 2), rng.randn(2)
    got = language_crf.forward_backward(words_, scores, move, first)
    for line in ([0, 1, 2], [3, 4]):
        weight = np.zeros((len(line), 2))
        for path in itertools.product(range(2), repeat=len(line)):
            total = first[path[0]] + sum(scores[w, s] for w, s in zip(line, path, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(path))
            for k, s in enumerate(path):
                weight[k, s] += np.exp(total)
        assert np.allclose(got[line], weight / weight.sum(axis=1, keepdims=True), atol=1e-5)


def test_url_filter_rules_and_reputation(spark):
    urls = [
        "http://www.Example.com/en/1", "https://a.example.com/en/x?q=1", "http://bad.org/1", "nothing", None,
        "ftp://x.net/es/1#f", "http://notexample.com.evil.org/en/", "http://net/fr/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    bad = spark.createDataFrame([("http://bad.org/x", 1)] * 40 + [("http://good.org/x", 0)] * 40, "url string, bad int")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, bad).collect()}
    assert got[0] == ("www.example.com", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "example.com/en/", "block")
    assert got[2] == ("bad.org", None, "block")
    assert got[3] == got[4] == ("", None, "allow")
    assert got[5][1:] == ("net/es/", "block") and got[6][1] is None and got[7][1:] == ("net/fr/", "block")
    assert url_filter.url_filter(pages, bad.limit(0)).where("verdict = 'block'").count() == 3


def test_url_filter_equals_sql_where_reputation_blocks(spark, tmp_path):
    """Hosts good and bad under suffixes of one and two labels, against the query's SQL."""
    import duckdb

    rng = random.Random(31)
    pages, labels = [], []
    for host, rate, n in [("bad.co.uk", 0.9, 60), ("www.bad.co.uk", 0.8, 30), ("good.co.uk", 0.05, 80), ("spam.github.io", 1.0, 40),
                          ("me.github.io", 0.0, 40), ("a.mixed.example.org", 0.5, 30), ("co.uk", 0.4, 5), ("one", 0.9, 9), ("fine.example.com", 0.1, 70)]:
        for _ in range(n):
            doc = len(labels)
            pages.append((doc, f"https://{host}/x/{doc}.html"))
            labels.append((doc, 1, int(rng.random() < rate)))
        pages.append((len(labels) + 10_000, f"http://{host}/not/labelled"))
    pages += [(99_999, None), (99_998, "nothing")]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(map(repr, r)) for r in registry.QUERIES["op9_url_filter"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(tuple(map(repr, r)) for r in con.sql(registry.SQL["op9_url_filter"]).fetchall())
    verdicts = {r[1].strip("'"): r[4].strip("'") for r in got if r[3] == "None"}
    assert verdicts["bad.co.uk"] == verdicts["spam.github.io"] == "block"
    assert verdicts["good.co.uk"] == verdicts["me.github.io"] == verdicts[""] == "allow"


def test_public_suffixes(spark):
    hosts = ["www.bbc.co.uk", "bbc.co.uk", "co.uk", "x.y.example.com", "example.com", "com", "me.github.io", ""]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_filter._levels(frame, url_filter.SUFFIXES).collect()}
    assert got["www.bbc.co.uk"] == got["bbc.co.uk"] == ("bbc.co.uk", "co.uk") and got["co.uk"] == ("co.uk", "co.uk")
    assert got["x.y.example.com"] == ("example.com", "com") and got["com"] == ("com", "com") and got["me.github.io"] == ("me.github.io", "github.io")


def test_posterior_of_a_rate(spark):
    """Against the beta distribution's own sums for whole parameters."""
    from math import comb

    cases = [(1, 1), (3, 5), (40, 60), (2, 30), (400, 600)]
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double")
    for (a, b), r in zip(cases, frame.select(url_filter.exceeds(F.col("a"), F.col("b"), 0.35).alias("p")).collect(), strict=True):
        n = a + b - 1
        exact = sum(comb(n, j) * 0.35**j * 0.65 ** (n - j) for j in range(a))
        assert abs(r["p"] - exact) < 1e-4


def test_pipeline(spark, folder):
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        assert 0.5 * docs.count() < after.count() <= docs.count(), name
        docs = spark.createDataFrame(after.collect(), after.schema)
    leaks = decontaminate.contaminated(docs, table(spark, folder, "benchmark"))
    assert leaks.count() == 0
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_judges_rows_of_one_id_and_of_none(spark, folder):
    """The near-duplicate stage against brute force over rows: different texts of one id, rows without one, names that clash."""
    rng = random.Random(37)
    base = [" ".join(words(rng, 80, 5000)) for _ in range(4)]
    near = lambda t, k: " ".join(w if i != k else "changed" for i, w in enumerate(t.split()))
    rows = [(5, base[0]), (5, base[1]), (3, near(base[0], 9)), (None, base[2]), (None, near(base[2], 3)), (8, base[2]), (None, base[3]), (8, base[2]), (9, ""), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row_h1": F.lit("x"), "group": F.lit(1), "n": F.lit(2), "toxicity": F.lit(0)})
    kept = corpus_pipeline.keep_one_of_similar(spark, frame, folder)
    assert kept.columns == frame.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(5, base[1]), (3, near(base[0], 9)), (8, base[2]), (None, base[3]), (9, ""), (4, None)], key=str)
    bench = table(spark, folder, "benchmark").first()["text"]
    leaky = spark.createDataFrame([(1, bench), (1, base[0]), (None, bench)], "doc_id long, text string")
    assert [r["text"] for r in corpus_pipeline.drop_benchmark_leaks(spark, leaky, folder).collect()] == [base[0]]


def test_pipeline_stages_on_odd_and_empty_tables(spark, folder, odd_docs):
    frame = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("extra", F.lit(1))
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs_after = stage(spark, docs, folder)
            assert docs_after.count() <= docs.count() or name == "packing"
