"""Analytic operators: rolling windows, quantile scores, cohorts, anomalies and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def rolling(df: DataFrame, by: list[str], order: str, value: str, rows: int = 7, digits: int = 2) -> DataFrame:
    """The mean and the sum over a row and the ones before it, of the same partition."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({"rolling_avg": F.round(F.avg(value).over(w), digits), "rolling_sum": F.sum(value).over(w)})


def _reaches(row: list[tuple[str, bool]], bound: tuple) -> Column:
    """Whether a row comes at or after a bound in the order of its columns; nulls come first where a column ascends, else last."""
    after, level = F.lit(False), F.lit(True)
    for (name, up), x in zip(row, bound):
        c = F.col(name)
        if x is None:
            beyond = c.isNotNull() if up else F.lit(False)
        else:
            beyond = F.coalesce(c > F.lit(x), F.lit(False)) if up else c.isNull() | (c < F.lit(x))
        after, level = after | (level & beyond), level & c.eqNullSafe(F.lit(x))
    return after | level


def quantile_scores(df: DataFrame, scores: dict[str, list[tuple[str, bool]]], n: int = 5, parts: int = 32) -> DataFrame:
    """NTILE over all rows, one for each score; its order is given as columns and whether they ascend, and must be unique.

    No task sorts all rows: bounds from a sample of some thousand keys cut them into ranges, rows are ranked within their range, and a range's
    first rank follows from the sizes of those before it. The ranks, and so the tiles, are exact whatever the sample.
    """
    df = cut(df)
    total = df.count()
    step = max(1, total // (parts * 64))
    used = list(dict.fromkeys(c for order in scores.values() for c, _ in order))
    sample = df.select(*used).filter(F.pmod(F.xxhash64(*used), F.lit(step)) == 0).limit(parts * 1_024).collect()
    place = {}
    for name, order in scores.items():
        # any bounds give the right ranks; well spaced ones give ranges of one size
        keys = list(dict.fromkeys(tuple(r[c] for c, _ in order) for r in sample if all(r[c] is not None for c, _ in order)))
        for c, up in reversed(list(enumerate(up for _, up in order))):
            keys.sort(key=lambda k: k[c], reverse=not up)
        bounds = [keys[len(keys) * i // parts] for i in range(1, parts)] if total > parts * 64 and len(keys) >= parts else []
        place[name] = sum((_reaches(order, x).cast("int") for x in bounds), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), p.alias("k")) for n, p in place.items()))).alias("r")
    sizes = {(r["name"], r["k"]): r["count"] for r in df.select(each).groupBy("r.name", "r.k").count().collect()}  # parts rows for each score at most
    for name, order in scores.items():
        before, at = {}, 0
        for _, k in sorted(x for x in sizes if x[0] == name):
            before[k], at = at, at + sizes[name, k]
        first = F.element_at(F.create_map(*(F.lit(x) for k in before for x in (k, before[k]))), F.col("_range")) if before else F.lit(0)
        keys = [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in order]
        rank = first + F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
        q, more = divmod(at, n)
        tile = F.when(rank < more * (q + 1), F.floor(rank / (q + 1))).otherwise(more + F.floor((rank - more * (q + 1)) / max(1, q))) + 1
        df = df.withColumn("_range", place[name]).withColumn(name, tile.cast("int")).drop("_range")
    return df


def z_scores(df: DataFrame, by: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumns({"mean": F.avg(value).over(w), "sd": F.stddev_samp(value).over(w)}).withColumn("z", F.try_divide(F.col(value) - F.col("mean"), F.col("sd")))


def sessions(events: DataFrame, user: str, at: str, tie: str, minutes: int = 30) -> DataFrame:
    """Events with gap_minutes and session_number: a gap of more than so many whole minutes starts a session."""
    w = Window.partitionBy(user).orderBy(at, tie)
    gap = F.expr(f"timestampdiff(MINUTE, _before, {at})")
    out = events.withColumn("_before", F.lag(at).over(w)).withColumn("gap_minutes", gap)
    starts = F.when(F.col("_before").isNull() | (F.col("gap_minutes") > minutes), 1).otherwise(0)
    return out.withColumn("session_number", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before")


def most_frequent(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the smallest."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_top")).select(*by, F.col("_top.v").alias(value))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value in the middle of each group, of two the larger; ranked in a window, so no group is gathered."""
    w = Window.partitionBy(*by)
    ranked = df.filter(F.col(value).isNotNull()).select(*by, value, F.row_number().over(w.orderBy(value)).alias("_i"), F.count("*").over(w).alias("_n"))
    return ranked.filter("_i = _n div 2 + 1").select(*by, value)


def rate(df: DataFrame, by: list[str], flag: str, name: str = "rate") -> DataFrame:
    """The share of rows whose flag is set."""
    return df.groupBy(*by).agg(F.avg(F.col(flag).cast("double")).alias(name))


def forward_label(df: DataFrame, by: str, order: str, flag: str, days: int = 7, name: str = "label") -> DataFrame:
    """The largest flag over the next days' rows, for rows that have that many days ahead of them."""
    w = Window.partitionBy(by)
    out = df.withColumns({name: F.max(flag).over(w.orderBy(order).rowsBetween(1, days)), "_last": F.max(order).over(w)})
    return out.filter(F.col(order) <= F.date_sub("_last", days)).drop("_last")
