"""Sources and sinks. Schemas are always given, never inferred, unless asked for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.history import apply_changes, merge_upsert


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: StructType | str | None, header: bool = True, null_value: str = "") -> DataFrame:
    """A CSV file with an explicit schema; without one its types are inferred, which reads it twice."""
    reader = spark.read.option("header", header).option("nullValue", null_value)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder that spark.checkpoint.dir names. Only a session on one machine may go without: it gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint()


def with_load_metadata(df: DataFrame, source_file: str | None = None, loaded_at=None) -> DataFrame:
    """Adds _loaded_at and _source_file."""
    return df.withColumns({
        "_loaded_at": F.lit(loaded_at).cast("timestamp") if loaded_at is not None else F.current_timestamp(),
        "_source_file": F.lit(source_file) if source_file is not None else F.input_file_name(),
    })


def jdbc_options(url: str, table: str, user: str, password: str, driver: str = "org.postgresql.Driver", column: str | None = None, bounds: tuple | None = None, parts: int = 1) -> dict[str, str]:
    """Options of a JDBC read; with a column and its bounds it is read in several parts."""
    own = {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver}
    if column and bounds and parts > 1:
        own |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return own


def jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def migrate(spark: SparkSession, tables: list[str], target: str, read=None, **options) -> dict[str, int]:
    """Copies tables whole from JDBC, or from what read(table) gives, to parquet; returns their row counts as written."""
    counts = {}
    for t in tables:
        replace(read(t) if read else jdbc(spark, table=t, **options), f"{target.rstrip('/')}/{t}")
        counts[t] = spark.read.parquet(f"{target.rstrip('/')}/{t}").count()  # from the files' footers
    return counts


def load(spark: SparkSession, path: str, schema: StructType | str, target: str, expected: int | None = None, null_value: str = "") -> int:
    """A CSV file into a bronze table, replaced whole, with its metadata; the rows that arrived, which must be as many as expected."""
    replace(with_load_metadata(csv(spark, path, schema, null_value=null_value), path), target)
    n = spark.read.parquet(target).count()
    if expected is not None and n != expected:
        raise ValueError(f"{target}: {n} rows, {expected} expected")
    return n


def swap(df: DataFrame, path: str) -> None:
    """Replaces a table by rows that may come from it: they are written beside it first, and take its place by a rename."""
    spark, new, old = df.sparkSession, f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"
    df.write.mode("overwrite").parquet(new)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(at(new), at(path)):
        raise OSError(f"{new} cannot be moved")
    fs.delete(at(old), True)
    spark.catalog.refreshByPath(path)


def merge_into(spark: SparkSession, path: str, source: DataFrame, keys: list[str], compare: list[str], **more) -> None:
    """MERGE into a parquet table."""
    swap(merge_upsert(spark.read.parquet(path), source, keys, compare, **more), path)


def apply_into(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], **more) -> None:
    """A batch of changes into a parquet table, which then holds the current state."""
    swap(apply_changes(spark.read.parquet(path), changes, keys, **more), path)


def change_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of change rows with their operation (I, U, D) and sequence, from JSON files in the order they came."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def replicate(changes: DataFrame, path: str, checkpoint: str, keys: list[str], seconds: int = 300, **more):
    """Keeps a parquet table at the state that the changes lead to, one micro-batch after the other, every so many seconds. A batch that is run again changes nothing."""
    def write(batch: DataFrame, n: int) -> None:
        apply_into(batch.sparkSession, path, batch, keys, **more)

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(write)


def kafka_options(servers: str, topic: str, starting: str = "latest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"}


def kafka_stream(spark: SparkSession, **options) -> DataFrame:
    """A subscription's messages, with the raw text in value; needs Spark's Kafka package."""
    return spark.readStream.format("kafka").options(**kafka_options(**options)).load().select(F.col("value"))


def rows(spark: SparkSession, data: list, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def text_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of raw text lines from files; Kafka's value column takes its place in production."""
    r = spark.readStream.format("text")
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(folder)


def on_day(df: DataFrame, at: str, day: str) -> DataFrame:
    """The rows of one day, as a half-open range, which reaches the scan."""
    start = F.lit(f"{day} 00:00:00").cast(df.schema[at].dataType)
    return df.filter((F.col(at) >= start) & (F.col(at) < start + F.expr("INTERVAL 1 DAY")))


def dates(spark: SparkSession, first: str, last: str, name: str = "date") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias(name))


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that df holds, so a re-run gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Appends each micro-batch to a parquet table; a batch that is run again replaces its own folder."""
    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)


def console(df: DataFrame, mode: str = "append"):
    return df.writeStream.outputMode(mode).format("console")
