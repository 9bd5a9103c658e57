"""A cleaning pipeline over documents: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet and rereads as the next
stage's documents.  All but the last return the columns of documents; extra
columns pass through, whatever their names, repeated rows are kept unless a
stage's decision drops them, and an empty table stays empty.  Each stage's table
is deleted when the next one is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, jaccard_join, packing, pii, toxicity
from sparkloom.llm.common import delete_path, free_name, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; it learns from the labels of the documents given."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.learning_rows())
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < 0.5).select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest id (rows without one come last), then of the least text hash.

    Rows are told apart by id and text, so different texts under one id are
    judged each for itself.  Texts without words are alike to nothing and stay.
    """
    h1, h2 = free_name(docs, "row_h1"), free_name(docs, "row_h2")
    row = [h1, h2]
    marked = docs.withColumns({h1: F.xxhash64("doc_id", "text"), h2: F.xxhash64("text", F.lit("second"), "doc_id")})
    groups = jaccard_join.jaccard_components(marked, carry=row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *row)
    leaders = groups.where("group IS NOT NULL").groupBy("group").agg(F.min(order).alias("first")).select(*[f"first.{c}" for c in row])
    wordless = groups.where("group IS NULL").select(*row).distinct()
    # a row that repeats as a whole is one document
    return marked.join(leaders.unionByName(wordless), row, "left_semi").dropDuplicates(row).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each judged by its own text."""
    found = free_name(docs, "benchmark_items")
    return decontaminate.count_items(docs, table(spark, sf_dir, "benchmark"), found).where(F.col(found) == 0).select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds; null texts stay null, and n_chars follows the text."""
    model = pii.train(docs)
    # what the operator appends must not take the place of columns of that name
    taken = {c.lower() for c in pii.COLUMNS}
    apart = {c: free_name(docs, f"kept_{c}") for c in docs.columns if c.lower() in taken}
    clean = free_name(docs, "redacted")
    found = pii.personal_data(docs.withColumnsRenamed(apart), model, redacted_col=clean)
    text = F.when(F.col("text").isNotNull(), F.col(clean))
    n_chars = F.length(text).cast("long")
    changed = F.col(clean) != F.col("text")
    found = found.withColumn("n_chars", F.when(changed, n_chars).otherwise(F.col("n_chars"))).withColumn("text", text)
    return found.select(*[F.col(apart.get(c, c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, as the packing operator returns it."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: The classifier, the span model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
