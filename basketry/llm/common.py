"""Helpers that the operators of this package share."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.tables import cut

#: Rows in an Arrow batch: texts can be long, and a batch is held whole in a Python worker.
BATCH_ROWS = 512
WORDS = r"[\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows; Spark bounds it by bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut_plainly(df: DataFrame) -> DataFrame:
    """cut() without what Catalyst estimated: in a loop of joins the estimates would be squared every round."""
    done = cut(df)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), df.sparkSession)


def cut_dealt(df: DataFrame, parts: int, on: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """cut() of then(rows dealt out by on). Tables that are dealt out alike join by on without another shuffle, and this one's files, with those before it, go at once."""
    conf = df.sparkSession.conf
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # an adaptive plan does not say how its rows are dealt
    before = {k: conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        return cut(then(df.repartition(parts, on)))
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


def lookup(rows: DataFrame, about: DataFrame, on: str, heavy: Column, most: int) -> DataFrame:
    """rows join about, which has one row for each value of on. The values that heavy holds for, most at most, are broadcast, so no hot value meets in one task."""
    hot = about.filter(heavy).limit(most + 1).count()
    if not hot or hot > most:
        return rows.join(about, on)
    many = F.broadcast(about.filter(heavy))
    return rows.join(many, on).unionByName(rows.join(many.select(on), on, "left_anti").join(about.filter(~heavy), on))


def map_rows(df: DataFrame, columns: list[str], schema: str | StructType, make: Callable[[], Callable]) -> DataFrame:
    """One output row for each input row. make() runs once in each task and gives a function from the row's values to a tuple."""
    small_batches(df.sparkSession)
    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            rows = [f(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            cols = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


def gathered(parts: RDD, merge: Callable):
    """What merge makes of one value from each task, in a tree of so many levels that about eight values reach the driver, however many tasks there are; None of no task."""
    n = parts.getNumPartitions()
    return parts.treeReduce(merge, max(2, math.ceil(math.log(max(2, n), 8)))) if n else None


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for arrays of uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links, as (node, component) with the smallest node of each.

    Large-star and small-star by turns: each node ties its larger neighbours, then its smaller ones and itself, to the smallest of them
    all, until every link leads to its component's smallest node. The links never grow in number, and the rounds needed grow with a power of
    the logarithm of the nodes, in whatever order their ids lie. Links that repeat or join a node to itself are harmless; no links give no rows.
    """
    x, y = F.col(a), F.col(b)
    links = cut_plainly(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u <> v").distinct())  # u is the larger one
    while not _stars(links):
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        links = cut_plainly(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        links = cut_plainly(links.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())


def _stars(links: DataFrame) -> bool:
    """Whether each node that has a smaller neighbour has that one only, and no larger one."""
    ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()
