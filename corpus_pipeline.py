"""The corpus pipeline: quality classifier, quality rules, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents.  run() writes each stage's rows as Parquet in the
shared folder and reads them again for the next.

Verdicts stay with their row: the first, second and fourth stage hand whole rows through
their operator, so that rows which share a doc_id or have none are judged each by its own
text, and columns of any name come out as they came in.  Rows with null or empty texts are
judged like others (the rules reject them).  Equal rows are near copies of each other, and
one stays; so do, of rows that share a doc_id in one group, those that differ in their text.
Rows without a doc_id link with nothing and stay, but of those of one text one.  Very long
texts are read whole.  Ties: the least doc_id of a group stays.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import minhash, packing, quality_knn, quality_rules, substrings
from quillspark.llm.common import save, table

#: Stages on word shingles take five words and a similarity of 0.8 or more.
SHINGLE, PER, OF = 5, 80, 100
#: Documents whose score is less go.
LEAST_QUALITY = 0.3


def _whole(verdicts: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows as they came in."""
    return verdicts.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without labelled rows, all of them."""
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"))
    return _whole(quality_knn.score(docs, model, keep_row=True).where(f"score >= {LEAST_QUALITY}"), docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep."""
    learned = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return _whole(quality_rules.judge(docs, learned, keep_row=True).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id; of rows that are equal in doc_id and text, one."""
    gone = minhash.near_duplicates(docs, SHINGLE, PER, OF).where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs.doc_id == gone._gone, "left_anti")
    return left.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that recur; a document that loses nothing keeps its text as it is."""
    done = substrings.remove_repeats(docs, keep_row=True)
    less, row = F.col("n_removed") > 0, F.col("_row")
    new = {"text": F.when(less, F.col("kept_text")).otherwise(row.getField("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(less, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(row.getField("n_chars"))
    return done.select(*(new.get(c, row.getField(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", pack),
]

#: SQL cannot express the learned stages; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a directory."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, f"stage{k}")
    return docs
