"""A logistic regression with balanced classes, split by time, evaluated, and promoted only above a bar."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def train(df: DataFrame, numeric: list[str], categorical: list[str], label: str) -> PipelineModel:
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # two rows
    total = sum(n.values())
    weight = F.when(F.col(label) == 1, total / (2 * max(1, n.get(1, 0)))).otherwise(total / (2 * max(1, n.get(0, 0))))
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical])
    parts = VectorAssembler(inputCols=numeric + [f"{c}_v" for c in categorical], outputCol="_x")
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w")
    return Pipeline(stages=[*index, hot, parts, StandardScaler(inputCol="_x", outputCol="features"), model]).fit(df.withColumn("_w", weight))


def evaluate(scored: DataFrame, label: str) -> dict[str, float]:
    many = lambda m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(scored)
    return {"roc_auc": BinaryClassificationEvaluator(labelCol=label).evaluate(scored), "accuracy": many("accuracy"), "f1": many("f1")}


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with the probability of the label and the predicted label, whatever it lacks of the label itself."""
    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("probability")[1].alias("probability"), F.col("prediction").cast("int").alias("predicted"))


def weights(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, weight), the largest first; df names the features, as training data does."""
    attrs = model.transform(df.limit(1)).schema["_x"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    w = model.stages[-1].coefficients.toArray().tolist()
    rows = [(names.get(i, str(i)), x) for i, x in enumerate(w)]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double").orderBy(F.desc(F.abs("weight")), "feature")


def passes(metrics: dict[str, float], bar: float = 0.8) -> bool:
    return metrics["roc_auc"] >= bar


def promote(model: PipelineModel, metrics: dict[str, float], path: str, bar: float = 0.8) -> bool:
    """Saves the model if it is good enough."""
    if not passes(metrics, bar):
        return False
    model.write().overwrite().save(path)
    return True


def drift(before: DataFrame, after: DataFrame, columns: list[str], bins: int = 10, bar: float = 0.1) -> DataFrame:
    """(feature, distance, drifted): the L-infinity distance between the two distributions of each column, numbers over the bins of the first one's range and others by value.
    Nulls are a value of their own; with an empty table on either side the distance is null."""
    numeric = [c for c in columns if isinstance(before.schema[c].dataType, NumericType)]
    edges = before.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max)))).first() if numeric else {}

    def binned(c):
        if c not in numeric or edges[f"lo_{c}"] is None:
            return F.coalesce(F.col(c).cast("string"), F.lit("null"))
        lo, wide = edges[f"lo_{c}"], (edges[f"hi_{c}"] - edges[f"lo_{c}"]) or 1.0
        return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c).cast("double") - lo) / wide * bins))).cast("string"), F.lit("null"))

    def shares(df, n):
        long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), binned(c).alias("bin")) for c in columns))).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
        return long.select("x.*", (F.col("k") / F.sum("k").over(Window.partitionBy("x.feature"))).alias(n))

    gap = F.max(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))
    both = F.when((F.count("a") > 0) & (F.count("b") > 0), gap)
    found = shares(before, "a").join(shares(after, "b"), ["feature", "bin"], "full").groupBy("feature").agg(both.alias("distance"))
    every = before.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return every.join(found, "feature", "left").withColumn("drifted", F.col("distance") > bar)
