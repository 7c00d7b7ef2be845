"""What several operators share: the word pattern, staged tables, name clashes."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import shipping
from tessera.shipping import spread

__all__ = ["BROADCAST_ROWS", "SPACE", "WORD", "documents", "forget", "let", "partitions", "shared_dir", "ship", "small", "staged", "text_of", "without", "word_count"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A side is broadcast only if it was counted and has no more rows than this; one of numbers
#: only, no more than BROADCAST_IDS numbers.
BROADCAST_ROWS = 50_000
BROADCAST_IDS = 1_000_000


#: Rows that go to a Python worker at once. Spark's default of 10,000 whole texts takes too much
#: memory beside the executor's heap.
BATCH_ROWS, BATCH_KEY = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to workers, and small batches from now on, where nobody chose others."""
    shipping.ship(spark)
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def text_of(name: str = "text") -> Column:
    """The column as a string that is never null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text, null for null: word runs shrink to one letter, spaces to none."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda's variable, since an
    expression named inside another lambda would be computed again for every element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session that has none (as in
    tests) gets a temporary folder of this machine; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = sc._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Shuffle files of a finished query are of no use once its result is written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _clean_shuffles(spark: SparkSession):
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back.

    Cuts lineage and survives lost executors, since the files are in storage that
    all executors share. Every call writes a folder of its own.
    """
    path = f"{shared_dir(df.sparkSession)}/tessera-{label}-{uuid.uuid4().hex}"
    with _clean_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path  # what forget() removes
    return out


def forget(df: DataFrame) -> None:
    """Removes a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small, else as it is
    (then Spark shuffles, and AQE splits skewed partitions)."""
    n = df.count() if rows is None else rows
    kinds = [t for _, t in df.dtypes]
    most = BROADCAST_IDS // len(kinds) if set(kinds) <= {"bigint", "int"} else BROADCAST_ROWS
    return F.broadcast(df) if n <= most else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
