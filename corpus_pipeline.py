"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; all but the last return the columns of ``docs``.  Stages are written as Parquet
and read again, so a lost executor costs at most one stage's tasks.

Decisions stay on their row: null and repeated ids are rows of their own in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import language, minhash, packing, secrets
from gridloom.llm.common import let_go, materialise, shared_folder
from gridloom.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the compression classifier rejects.

    The classifier is fitted on a bounded sample of the labelled rows.  A document whose text is null,
    has no letter, or compresses equally well with two languages goes; so does every one if no row has a label.
    Equal rows stay or go together, null ids are kept, an empty table stays empty.
    """
    known = language.fit_dictionaries(docs)
    return language.identify(docs, known, keep="row").filter("not rejected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, Jaccard 0.8 or more) the row of the least doc_id.

    Where ids are null or repeated rows are numbered in the order of their ids, null first, and the first of a group stays:
    so of equal rows one does, and rows that share an id but not a text are judged apart.  Documents without words stay.
    """
    let_go(spark)
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        kept = minhash.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).filter("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("place"), "text", "row"))
    kept = minhash.near_duplicates(rows, id_col="place", width=5, percent=80).filter("kept").select("place")
    return rows.join(kept, "place", "left_semi").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blanks credentials that look live; examples that are widely copied among or within sources stay.

    No document goes; n_chars follows the changed text.  Null texts stay null; a null source is an owner of its own.
    """
    let_go(spark)
    found = secrets.scan_secrets(docs, owner=F.col("source"), keep="row").select("row.*", F.col("live").alias("_live"))
    hit = F.size("_live") > 0
    changed = {"text": F.when(hit, secrets.redact(F.col("text"), F.col("_live"))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(changed["text"]).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids with lexical neighbours; every row is packed, null texts as the end id alone."""
    let_go(spark)
    return packing.pack_documents(docs, tokenizer=tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", known_language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack)]

#: SQL can express neither the compression classifier nor the packing; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this run wrote, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, writing each one's rows in the shared folder; only the last one's rows stay there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            _remove(spark, before)
        before = f"{at}/{name}"
    return docs
