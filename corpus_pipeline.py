"""From documents to packed training sequences, stage by stage.

Every stage but the last takes and returns the columns of documents; the last returns packed pieces. A stage works on all
rows the one before it kept. Null texts count as empty (and fail the quality rules), null ids are never anybody's
duplicates, repeated rows share their fate, columns beyond those of documents go through, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.llm import line_crf, near_dedup, packing, quality_model, secrets
from stratamesh.llm._io import table, written
from stratamesh.llm.queries import TOKENIZER, held_out


def unused(docs: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    while name in docs.columns:
        name = f"{name}_"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.5 or more. Trained on labelled documents of the whole table."""
    model = quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))
    score = unused(docs, "score")
    return quality_model.score(docs, model, out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are content for the most part. Trained on labelled documents of the whole table."""
    model = line_crf.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    places = {c: f"column{i}" for i, c in enumerate(docs.columns)}  # marks have names that a column may have too
    marked = line_crf.mark(docs.select(*(F.col(c).alias(p) for c, p in places.items())), model, text=places["text"])
    return marked.where("kept").select(*(F.col(p).alias(c) for c, p in places.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every near-duplicate group."""
    other = unused(docs, "gone")
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(other), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret's span replaced by a mark, n_chars counted anew."""
    spans = unused(docs, "spans")
    out = secrets.redacted(secrets.scan(docs, secrets.fit(docs), out=spans), spans=spans).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
#: Trained models and tokenizers can't be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
