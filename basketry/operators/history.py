"""Latest rows, versions over time, as-of joins, upserts and change batches, as pure functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FOREVER


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order; order should end in something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stage(df: DataFrame, keys: list[str], order: list[Column], columns: dict[str, Column], flags: dict[str, Column] | None = None) -> DataFrame:
    """The shape of every staging model: latest row, cleaned columns, quality flags, no null keys."""
    out = latest_per_key(df, keys, order).filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return out.select(*(c.alias(n) for n, c in {**columns, **(flags or {})}.items()))


def periods(df: DataFrame, key: str, start: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Versions by effective date: each ends the day before the next one starts, the last never."""
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return df.withColumns({valid_from: F.col(start), valid_to: F.coalesce(F.date_sub(after, 1), F.to_date(F.lit(FOREVER))), "is_current": after.isNull()})


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, at: str, half_open: bool = False, how: str = "inner") -> DataFrame:
    """Facts with the version that was valid then: a hash join on the key with the range as its residual."""
    v = versions.withColumnRenamed(key, "_key")
    upto = F.col(at) < F.col("valid_to") if half_open else F.col(at) <= F.col("valid_to")
    return facts.join(v, (F.col(key) == F.col("_key")) & (F.col(at) >= F.col("valid_from")) & upto, how).drop("_key")


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], compare: list[str], null_safe: bool = False, follow: list[str] | None = None, order: list[Column] | None = None, outer: bool = False) -> DataFrame:
    """Rows of source replace the compared columns, and those that follow them, where a compared one differs, and are added where they are new; columns
    that source lacks stay null in new rows. Of source rows with one key the first in order counts; without an order they are an error, as in MERGE.
    With outer they all count, as in a full outer join: a target row comes once for each of them, and what source holds replaces all but by nulls."""
    if order is not None:
        source = latest_per_key(source, keys, order)
    elif not outer:
        n = F.count("*").over(Window.partitionBy(*keys))
        twice = F.when(n > 1, F.raise_error(F.lit("several source rows have one key: give an order"))).otherwise(F.lit(True))
        source = source.withColumn("_one", twice).filter("_one").drop("_one")
    changed = [*compare, *(follow or [])]
    s = source.select(*(F.col(k).alias(f"_s_{k}") for k in keys), *(F.col(c).alias(f"_s_{c}") for c in changed), F.lit(True).alias("_s"))
    on = [F.col(k) == F.col(f"_s_{k}") for k in keys]
    differs = None
    for c in compare:
        d = ~F.col(c).eqNullSafe(F.col(f"_s_{c}")) if null_safe else F.coalesce(F.col(c) != F.col(f"_s_{c}"), F.lit(False))
        differs = d if differs is None else differs | d
    hit = F.coalesce(F.col("_s"), F.lit(False)) & differs
    value = lambda c: F.coalesce(f"_s_{c}", c) if outer else F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c))
    kept = target.join(s, on, "left").select(*(value(c).alias(c) if c in changed else F.col(c) for c in target.columns))
    return kept.unionByName(source.join(target, keys, "left_anti"), allowMissingColumns=True).select(*target.columns)


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], op: str = "op", seq: str = "seq") -> DataFrame:
    """The current state after a batch of inserts, updates (I, U) and deletes (D): the last change of a key counts."""
    last = latest_per_key(changes, keys, [F.desc(seq)])
    return target.join(last, keys, "left_anti").unionByName(last.filter(F.col(op) != "D").select(*target.columns))


def snapshot(history: DataFrame | None, current: DataFrame, key: str, check: list[str], as_of: Column, initial: Column | None = None) -> DataFrame:
    """History by change detection: versions that changed or went are closed at as_of, changed and new rows opened."""
    opened = lambda df, at: df.withColumns({"valid_from": at, "valid_to": F.lit(None).cast("timestamp")})
    if history is None:
        return opened(current, initial if initial is not None else as_of)
    is_open = F.col("valid_to").isNull()
    now = current.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in check), F.lit(True).alias("_here"))
    same = F.coalesce(F.col("_here"), F.lit(False))
    for c in check:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    was = history.filter(is_open).join(now, F.col(key) == F.col("_k"), "left").withColumn("valid_to", F.when(~same, as_of)).select(*history.columns)
    still = was.filter(is_open).select(key)
    fresh = opened(current.join(still, key, "left_anti"), as_of)
    return history.filter(~is_open).unionByName(was).unionByName(fresh.select(*history.columns))


def replace_recent(built: DataFrame, fresh: DataFrame, at: str, as_of: Column, days: int = 3) -> DataFrame:
    """The functional form of an incremental model: the last days are taken from fresh, the rest stays."""
    since = F.date_sub(as_of, days)
    return built.filter(F.col(at) < since).unionByName(fresh.filter(F.col(at) >= since))
