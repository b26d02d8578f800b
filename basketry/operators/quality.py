"""Declarative data quality: rules in, one row per rule out, all rules of a table in a single aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """passes: a row condition, where null fails; or unique: a column whose values must differ, where nulls are let be; or among: a column and the values it may have besides null. severity: error, or warn, which fails no scan."""

    name: str
    dimension: str
    passes: str | None = None
    unique: str | None = None
    threshold: float = 1.0
    severity: str = "error"
    among: tuple[str, tuple] | None = None


def not_null(c: str) -> Rule:
    return Rule(f"{c}_not_null", "COMPLETENESS", f"{c} IS NOT NULL")


def accepted(c: str, *values) -> Rule:
    return Rule(f"{c}_accepted", "VALIDITY", among=(c, values))


def _condition(r: Rule) -> Column:
    return F.expr(r.passes) if r.among is None else F.col(r.among[0]).isNull() | F.col(r.among[0]).isin(*r.among[1])


def scan(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, dimension, severity, evaluated, passed, failed, pass_pct, ok) for each rule. All row conditions share one aggregate; a unique column has one of its own,
    counted in two steps, so that no row is multiplied by the number of rules. A row fails a unique rule if its value is not null and stands in another row too."""
    rows = F.count(F.lit(1)).alias("n")
    plain, unique = [r for r in rules if not r.unique], [r for r in rules if r.unique]
    about = lambda r: (F.lit(r.name).alias("rule"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"), F.lit(r.threshold).alias("threshold"))
    parts = []
    if plain:
        one = df.agg(rows, *(F.count_if(F.coalesce(_condition(r), F.lit(False))).alias(f"p{i}") for i, r in enumerate(plain)))
        parts.append(one.select("n", F.explode(F.array(*(F.struct(*about(r), F.col(f"p{i}").alias("passed")) for i, r in enumerate(plain)))).alias("r")).select("r.*", F.col("n").alias("evaluated")))
    for r in unique:
        g = df.groupBy(r.unique).agg(rows)
        good = F.coalesce(F.sum(F.when(F.col(r.unique).isNull() | (F.col("n") == 1), F.col("n")).otherwise(0)), F.lit(0))
        parts.append(g.agg(good.alias("passed"), F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated")).select(*about(r), "passed", "evaluated"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    share = F.coalesce(F.try_divide(F.col("passed"), F.col("evaluated")), F.lit(1.0))
    return out.select(
        "rule", "dimension", "severity", "evaluated", "passed", (F.col("evaluated") - F.col("passed")).alias("failed"), F.round(share * 100, 2).alias("pass_pct"), (share >= F.col("threshold")).alias("ok")
    )


def overall(result: DataFrame) -> DataFrame:
    """One row for a scan: rules, those that failed as an error and as a warning, and whether it passed, which warnings do not hinder."""
    bad = ~F.col("ok")
    return result.agg(
        F.count("*").alias("rules"), F.count_if(bad & (F.col("severity") == "error")).alias("errors"), F.count_if(bad & (F.col("severity") == "warn")).alias("warnings"),
        (F.count_if(bad & (F.col("severity") == "error")) == 0).alias("passed"),
    )


def count_gate(df: DataFrame, least: int, most: int, at: str | None = None, since: Column | None = None) -> DataFrame:
    """(n, ok): whether the rows, or those not older than since, are so many."""
    df = df.filter(F.col(at) >= since) if at is not None and since is not None else df
    return df.agg(F.count("*").alias("n")).withColumn("ok", F.col("n").between(least, most))


def report(result: DataFrame) -> DataFrame:
    """A line of text for each rule."""
    return result.select("rule", F.concat_ws(" ", F.when(F.col("ok"), "PASS").otherwise("FAIL"), "rule", "dimension", F.col("passed").cast("string"), F.lit("of"), F.col("evaluated").cast("string")).alias("line"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def freshness(df: DataFrame, at: str, as_of: Column, warn_hours: int = 24, error_hours: int = 48) -> DataFrame:
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(F.max(at))) / 3600
    return df.agg(age.alias("age_hours")).withColumn("status", F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass"))


def price_period_violations(df: DataFrame) -> DataFrame:
    return df.filter("valid_from >= valid_to")


def price_period_overlaps(df: DataFrame, key: str = "product_id") -> DataFrame:
    """Periods that reach into the next one of the same product."""
    after = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from", "valid_to"))
    return df.withColumn("_after", after).filter("valid_to >= _after").drop("_after")


def failing(tests: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(test, severity, failures, ok) from tests as (failing rows, severity); only an error is not ok."""
    out = None
    for name, (rows, severity) in tests.items():
        one = rows.agg(F.count("*").alias("failures")).select(F.lit(name).alias("test"), F.lit(severity).alias("severity"), "failures", ((F.col("failures") == 0) | F.lit(severity == "warn")).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out
