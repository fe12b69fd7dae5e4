"""What the operators of this subpackage share: materialising, ranks without a hot window, word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where that is unset and all is one machine, as in
    tests, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there.

    An executor lost later costs a read of that table, not a computation; the folder goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cut_files(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df, cut, and the names of the files that it lies in."""
    made = cut(df)
    return made, sorted(made.inputFiles())


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def gone(*tables: DataFrame) -> None:
    """Deletes the folders of tables that cut() wrote: nothing that is still to be computed may need them."""
    for table in tables:
        folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in table.inputFiles()}
        for spark, path in [x for x in _written if x[1].rsplit("/", 1)[-1] in folders]:
            _delete(spark, path)
            _written.remove((spark, path))


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before us
            return


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_bucket(md5_hex: Column, n: int) -> Column:
    """Bucket 0 to n-1 (n at most 2^28) that rises with the hex digest's own order."""
    return F.expr("0").cast("long") if n == 1 else F.floor(F.conv(F.substring(md5_hex, 1, 7), 16, 10).cast("long") * n / F.lit(1 << 28)).cast("long")


def running(df: DataFrame, keys: list[str], order: list[str], bucket: str, amount: Column, out: str) -> DataFrame:
    """Adds out: the sum of amount over the rows before this one, among those with the same keys, by (bucket, order).

    Only the rows of one bucket meet in a task: what precedes a bucket is summed from one row per bucket. So no key is
    too frequent, given that buckets are fine enough. Rows alike in keys, bucket and order may change places.
    """
    clash = f"_{out}_amount"
    df = df.withColumn(clash, amount)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys, bucket).agg(F.sum(clash).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    base = base.select(*[F.col(k).alias(f"_b_{k}") for k in [*keys, bucket]], "_base")
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in [*keys, bucket]]
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.withColumn("_in", F.coalesce(F.sum(clash).over(inside), F.lit(0))).join(base, on).withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base", clash, *[f"_b_{k}" for k in [*keys, bucket]])
