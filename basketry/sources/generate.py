"""Deterministic test data: messy event lines, change rows, and a simulation of demand and stock."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = ("north", "south", "east", "west")
STAGES = ("placed", "picked", "packed", "shipped", "delivered")


def order_events(n: int, start: str = "2024-01-01T00:00:00", messiness: float = 0.05, seed: int = 1, every: int = 5) -> list[str]:
    """JSON lines of order events, one every so many seconds. With the given probability a line's time is one to five minutes old, or an optional field is missing;
    with half of it a line comes twice."""
    r, at, out = random.Random(seed), datetime.fromisoformat(start), []
    for i in range(n):
        when = at + timedelta(seconds=every * i)
        if r.random() < messiness:
            when -= timedelta(seconds=r.randint(60, 300))
        event = {
            "order_id": f"O{i // len(STAGES)}", "customer_id": f"C{r.randint(1, 50)}", "event_type": STAGES[i % len(STAGES)], "timestamp": when.strftime("%Y-%m-%dT%H:%M:%SZ"), "warehouse_zone": r.choice(ZONES), "items_count": r.randint(1, 9)
        }
        if r.random() < messiness:
            del event["items_count"]
        out.append(json.dumps(event))
        if r.random() < messiness / 2:
            out.append(out[-1])
    return out


def changes(spark: SparkSession, table: DataFrame, key: str, updates: dict[str, object], share: int = 10, start: int = 1) -> DataFrame:
    """Change rows for a table: of every so many keys one is updated and one deleted, by the remainder of its hash."""
    k = F.pmod(F.xxhash64(key), F.lit(share))
    updated = table.filter(k == 0).withColumns({c: F.lit(v).cast(table.schema[c].dataType) for c, v in updates.items()}).withColumn("op", F.lit("U"))
    return updated.unionByName(table.filter(k == 1).withColumn("op", F.lit("D"))).withColumn("seq", F.lit(start).cast("long"))


def simulate(products: DataFrame, first: str = "2025-01-01", days: int = 365, seed: int = 1) -> DataFrame:
    """A year of stock by product and day from (product_id, lead_time_days): demand by weekday, an order whenever stock falls under what the lead time needs, and a trailing seven-day
    mean of demand that starts short. A day depends on the one before, so each product runs in one go, in pandas."""
    shape = "product_id string, warehouse_id string, date date, units_sold int, qty_on_hand int, qty_received int, rolling_7d_avg_demand double, lead_time_days int, stockout_flag int"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        key, lead = str(p["product_id"].iloc[0]), int(p["lead_time_days"].iloc[0])
        r = random.Random(f"{seed}:{key}")
        base, rows, due, recent = r.randint(2, 20), [], {}, []
        stock = base * (lead + 7)
        for i in range(days):
            day = (datetime.fromisoformat(first) + timedelta(days=i)).date()
            got = due.pop(i, 0)
            want = max(0, round(r.gauss(base * (1.3 if day.weekday() >= 5 else 1.0), base * 0.3)))
            sold = min(want, stock + got)
            stock += got - sold
            recent = [*recent[-6:], want]
            if stock < base * lead and not due:
                due[i + max(1, lead)] = base * (lead + 7)
            rows.append((key, f"W{sum(map(ord, key)) % 3}", day, sold, stock, got, round(sum(recent) / len(recent), 2), lead, int(stock == 0)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")])

    return products.select(F.col("product_id").cast("string").alias("product_id"), F.col("lead_time_days").cast("int").alias("lead_time_days")).groupBy("product_id").applyInPandas(run, shape)
