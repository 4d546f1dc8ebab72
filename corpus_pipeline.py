"""A training-data pipeline over ``documents``: filtered, deduplicated, cleaned and encoded.

Each stage takes what the one before has written and returns the columns of documents,
the last one ids. Every stage works on all rows it is given, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldscope.llm import decontaminate, jaccard, pieces, secret_scan, texts, toxicity
from yieldscope.llm.catalog import table, vocabulary
from yieldscope.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of those given.

    Without evidence (no labels, or no weight in a text) the score is under 0.5 and documents stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, [texts.whole_row(docs), F.col("text")], model)
    return scored.where("score < 0.5").select("row__.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 80 %) one row: that with the smallest id, null ids last.

    Rows are told apart by id and text; of those that repeat both, one stays. Rows without
    shingles are no copies of each other and stay.
    """
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    # no null inside, so that keys are equal and sorted as whole values
    key = F.struct(F.isnull("doc_id").alias("last"), F.coalesce("doc_id", zero).alias("id"), F.xxhash64("text").alias("mark"))
    path = scratch_path(spark, "copies")
    jaccard.near_duplicates(docs.select(key.alias("doc_id"), "text"), size=5, percent=80).where("n_shingles > 0").groupBy(
        F.col("doc_id").alias("key__")).agg(F.first("component_id").alias("low__"), F.count("*").alias("c__")).where(
        "key__ <> low__ or c__ > 1").write.parquet(path)
    told = spark.read.parquet(path)
    row = docs.select(key.alias("key__"), texts.whole_row(docs))
    single = row.join(told.select("key__"), "key__", "left_anti").select("row__.*")
    repeated = (row.join(told.where("key__ = low__").select("key__"), "key__", "left_semi")
                .groupBy("key__").agg(F.first("row__").alias("row__")).select("row__.*"))
    return single.unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), [texts.whole_row(docs), F.col("text")])
    return found.where(F.size("runs") == 0).select("row__.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced and n_chars counted anew where they were."""
    dictionary = vocabulary("word_bpe_49k.json")
    found = secret_scan.scan(docs, [texts.whole_row(docs)], *secret_scan.fitted(docs, dictionary), dictionary)
    hit = F.size("secrets") > 0
    changed = {"text": F.when(hit, F.col("clean")).otherwise(F.col("row__.text")),
               "n_chars": F.when(hit, F.length("clean").cast("bigint")).otherwise(F.col("row__.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"row__.`{c}`")).alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and SentencePiece ids, ready to be packed."""
    encoded = pieces.encode(docs, [F.col("doc_id")], vocabulary("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", encode_pieces),
]
#: No SQL can tell what a trained classifier rejects; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each reading what the one before it has written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{path}/{i}")
            docs = spark.read.parquet(f"{path}/{i}")
    return docs
