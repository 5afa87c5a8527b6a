"""Results that are kept between queries: a table is named by what makes it and by the state of the files it is made of."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files at its end.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@lru_cache(maxsize=8)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="gridloom-kept-")


def kept_folder(spark: SparkSession) -> str:
    """Where kept tables are: in the folder that the cluster names in spark.checkpoint.dir; a temporary one of this application where there is only this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/kept"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def _digest(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


def plan_digest(df: DataFrame, version: str = "") -> str:
    """Names what a plan does, apart from the numbers that Spark gives its columns.

    Only plans over files can be named: rows that came from the driver or from an RDD don't stand in the plan.  Python functions
    don't either, so a plan with one needs a ``version``, which its owner changes with it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(key)
    conf.set(key, str(2**31 - 1))
    try:
        plan = df._jdf.queryExecution().analyzed().canonicalized()
        text = plan.toString()
        leaves = plan.collectLeaves()
        kinds = {leaves.apply(i).nodeName() for i in range(leaves.size())}
    finally:
        conf.set(key, before)
    strange = sorted(k for k in kinds if not k.startswith(("LogicalRelation", "Relation", "OneRowRelation")))
    if strange:
        raise ValueError(f"only plans over files can be kept, not {', '.join(strange)}")
    if not version and any(w in text for w in ("PythonUDF", "InPandas", "InArrow", "pythonUDF")):
        raise ValueError("a plan with Python functions needs a version")
    return _digest(text, version, str(df.schema.json()))


def input_digest(df: DataFrame) -> str:
    """Names the state of the plan's files: path, length and time of each, as the store tells them now."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    state = []
    for file in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        status = path.getFileSystem(conf).getFileStatus(path)
        state.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return _digest(*state)


def kept(df: DataFrame, folder: str | None = None, version: str = "") -> DataFrame:
    """The same rows, read from a table that is written the first time and again when an input file has changed.

    Tables of earlier states of the same plan's inputs are removed when a new one is whole.  A write that failed leaves no mark
    of its end and is done again.  To see new files read the input anew: a DataFrame lists its files when it is made.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    of_plan = f"{folder or kept_folder(spark)}/{plan_digest(df, version)}"
    state = input_digest(df)
    home = jvm.org.apache.hadoop.fs.Path(of_plan)
    store = home.getFileSystem(conf)
    if not store.exists(jvm.org.apache.hadoop.fs.Path(f"{of_plan}/{state}/_SUCCESS")):
        df.write.mode("overwrite").parquet(f"{of_plan}/{state}")
        for old in store.listStatus(home):
            if old.getPath().getName() != state:
                store.delete(old.getPath(), True)
    return spark.read.schema(df.schema).parquet(f"{of_plan}/{state}")


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Writes tables between the steps of one computation, by name, and gives them back as they are read; they are removed when it ends.

    When a table is written nothing reads the shuffles before it any more, and Spark may remove their files.
    """
    folder = f"{kept_folder(spark)}/steps-{uuid.uuid4().hex}"

    def write(df: DataFrame, name: str) -> DataFrame:
        before = spark.conf.get(_SHUFFLE_CLEANUP)
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(f"{folder}/{name}")
        finally:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        yield write
    finally:
        home = spark._jvm.org.apache.hadoop.fs.Path(folder)
        home.getFileSystem(spark._jsc.hadoopConfiguration()).delete(home, True)


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, by a reliable checkpoint in the folder of kept tables: nothing before it is read again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(kept_folder(df.sparkSession))
    return df.checkpoint(eager=True)
