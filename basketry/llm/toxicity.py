"""Toxicity by a classifier chain over the labelled categories.

The categories are predicted one after the other by linear models over words and the first letters of words; each later model also
takes the earlier categories' probabilities. It is trained on out-of-fold ones, so what it learns to trust is what it meets later.

Only the fit uses a sample, of at most ROWS_PER_CLASS labelled rows for each value of the last category, the ones with the smallest
hashes. Their features are counted and chosen in tasks; the driver gets the chosen ones and where they occur. Scoring reads every row, whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch, cut, map_rows, small_batches, table

#: Labelled rows for the fit, for each value of the last category.
ROWS_PER_CLASS = 2_500
FEATURES = 4_000
FOLDS = 5
STEMS = (4, 5, 6)
THRESHOLD = 0.5
CACHE = 300_000
WORD = regex.compile(r"\p{L}+")
SHAPE = 4


def features(word: str) -> list[int]:
    """The hashes of a word and of its first letters."""
    return [xxhash.xxh64_intdigest(word), *(xxhash.xxh64_intdigest("^" + word[:n]) for n in STEMS if len(word) >= n)]


def shape(text: str, words: list[str], distinct: int) -> tuple[float, ...]:
    """What lies in the text beside its words: shares of letters, of repeated words and of repeated lines, and its length."""
    lines = text.split("\n")
    n = len(text) or 1
    return sum(map(len, words)) / n, 1 - distinct / (len(words) or 1), 1 - len({*lines}) / len(lines), min(1.0, np.log1p(len(words)) / 10)


def read(text: str | None):
    words = WORD.findall((text or "").lower())
    found = {*words}
    return found, shape(text or "", words, len(found))


class Chain:
    """Linear models over selected features; weights are by feature, with the shape's and the earlier probabilities' last."""

    def __init__(self, names: list[str], chosen: np.ndarray, weights: list[np.ndarray]):
        self.names, self.chosen, self.weights = names, chosen, weights

    def columns(self) -> dict[int, int]:
        return {int(h): i for i, h in enumerate(self.chosen)}

    def predict(self, cols: list[int], extra: tuple[float, ...]) -> list[float]:
        out: list[float] = []
        for w in self.weights:
            n = len(self.chosen)
            z = w[-1] + (w[cols].sum() if cols else 0.0) + float(np.dot(w[n : n + SHAPE], extra)) + float(np.dot(w[n + SHAPE : -1], out))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, width: int, dense: np.ndarray, y: np.ndarray, decay: float = 2e-4, steps: int = 400) -> np.ndarray:
    """Class-balanced logistic regression with Adam over sparse ones (rows, cols) and dense columns; weights are sparse, dense, bias."""
    k = dense.shape[1]
    w, m, v = (np.zeros(width + k + 1) for _ in range(3))
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + dense @ w[width:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        grad = np.concatenate([np.bincount(cols, g[rows], width), dense.T @ g, [g.sum()]]) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def differences(df: np.ndarray, with_feature: list[np.ndarray], n: int, totals: list[int]) -> np.ndarray:
    """How much each feature's share of documents differs from class to class, in standard errors, at most over the categories.

    df: documents with the feature, with_feature: the same in each category's class 1, of n documents and totals in class 1."""
    best, share = np.zeros(len(df)), df / max(1, n)
    for pos, total in zip(with_feature, totals):
        n1, n0 = max(1.0, total), max(1.0, n - total)
        p, q = pos / n1, (df - pos) / n0
        best = np.maximum(best, np.abs(p - q) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0)))
    return best


def choose(rows: DataFrame, n: int, totals: list[int], most: int = FEATURES) -> np.ndarray:
    """The features in three documents or more that differ most, counted and compared in tasks, so only they reach the driver. rows: h, y0, y1..."""
    ys = [f"y{i}" for i in range(len(totals))]
    shape = "f long, n long, " + ", ".join(f"{y} long" for y in ys)
    arrow, found = arrow_schema(shape), arrow_schema("f long, best double")
    flip = np.uint64(1 << 63)  # keeps the order of hashes as signed numbers

    def tally(batches):
        for b in batches:
            arrays = [np.frombuffer(h, np.uint64) for h in b.column(0).to_pylist()]
            if arrays:
                values, at = np.unique(np.concatenate(arrays), return_inverse=True)
                doc = np.repeat(np.arange(len(arrays)), [len(h) for h in arrays])
                pos = [np.bincount(at, b.column(1 + i).to_numpy()[doc], len(values)).astype(np.int64) for i in range(len(ys))]
                yield batch(arrow, (values ^ flip).view(np.int64), np.bincount(at, minlength=len(values)), *pos)

    def rated(batches):
        for b in batches:
            f, df, *pos = (c.to_numpy() for c in b.columns)
            yield batch(found, f, differences(df, pos, n, totals))

    counts = rows.select("h", *ys).mapInArrow(tally, shape).groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n", *ys))).filter("n >= 3")
    top = counts.mapInArrow(rated, "f long, best double").filter("best > 5").orderBy(F.desc("best"), "f").limit(most).select("f").collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64) ^ flip)


def train(chosen: np.ndarray, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, labels: np.ndarray, names: list[str], folds: np.ndarray) -> Chain:
    """rows, cols: which documents have which of the chosen features; labels: a column of 0 and 1 for each category, in the order of the chain."""
    n, weights = len(labels), []
    for i, y in enumerate(labels.T):
        weights.append(logistic(rows, cols, n, len(chosen), dense, y))
        if i + 1 < labels.shape[1]:
            out = np.zeros(n)
            for f in range(FOLDS):
                test = folds == f
                keep = ~test[rows]
                if test.any() and (~test).any():
                    new = np.cumsum(~test) - 1
                    w = logistic(new[rows[keep]], cols[keep], int((~test).sum()), len(chosen), dense[~test], y[~test])
                    z = np.bincount(rows, w[cols], n) + dense @ w[len(chosen) : -1] + w[-1]
                    out[test] = (1 / (1 + np.exp(-np.clip(z, -40, 40))))[test]
            dense = np.column_stack([dense, out])
    return Chain(names, chosen, weights)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], key: str = "doc_id", column: str = "text", rows_per_class: int = ROWS_PER_CLASS) -> Chain | None:
    """A chain for categories, name -> SQL condition over labels, in order. Without two classes of the last one there is nothing to fit: None.

    Labels of a null key, and documents without a label, take no part. Of several labels of a key each category takes the largest, and of several texts
    the one with the smallest hash counts, so at most twice rows_per_class rows come to the driver, and always the same ones.
    """
    small_batches(docs.sparkSession)
    *_, last = names = list(categories)
    y = [F.max(F.coalesce(F.expr(c).cast("int"), F.lit(0))).alias(n) for n, c in categories.items()]
    marked = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(*y)
    place = F.pmod(F.xxhash64(key, F.lit(8)), F.lit(1 << 30))
    many = {r[last]: r["count"] for r in marked.groupBy(last).count().collect()}  # two rows
    parts = []
    for v in (0, 1):  # a bound on the hash first, so that no task sorts more than a little over what is wanted
        few = marked.filter((F.col(last) == v) & (place < int(min(1.0, (1.2 * rows_per_class + 100) / max(1, many.get(v, 0))) * (1 << 30))))
        parts.append(few.orderBy(place, key).limit(rows_per_class))
    taken = parts[0].unionByName(parts[1])

    def gather(batches):
        for b in batches:
            ks, texts, *ys = (c.to_pylist() for c in b.columns)
            out, about, order = [], [], []
            for k, text in zip(ks, texts):
                words, extra = read(text)
                out.append(np.array(sorted({x for w in words for x in features(w)}), dtype=np.uint64).tobytes())
                about.append(pickle.dumps((repr(k), extra)))
                order.append(xxhash.xxh64_hexdigest(text or "") + repr(k))
            yield batch(arrow, [repr(k) for k in ks], order, out, about, *ys)

    own = [f"y{i}" for i in range(len(names))]
    shape = "k string, place string, h binary, about binary, " + ", ".join(f"{y} int" for y in own)
    arrow = arrow_schema(shape)
    read_all = docs.select(key, column).join(F.broadcast(taken), key).select(key, column, *names).mapInArrow(gather, shape)
    rows = cut(read_all.groupBy("k").agg(F.min_by(F.struct("h", "about", *own), "place").alias("r")).select("r.*"))
    n, *totals = rows.agg(F.count("*"), *(F.coalesce(F.sum(y), F.lit(0)) for y in own)).first()
    if totals[-1] in (0, n):
        return None
    chosen = choose(rows, n, totals)
    wide, told = "about binary, cols binary, " + ", ".join(f"{y} int" for y in own), docs.sparkSession.sparkContext.broadcast(chosen)
    wide_arrow = arrow_schema(wide)

    def places(batches):
        some = np.append(told.value, np.uint64(0))  # what lies beyond the last one is not 0
        for b in batches:
            cols = []
            for h in b.column(1).to_pylist():
                at = np.searchsorted(some[:-1], h := np.frombuffer(h, np.uint64))
                cols.append(at[some[at] == h].astype("<u4").tobytes() if len(some) > 1 else b"")
            yield batch(wide_arrow, b.column(0), cols, *b.columns[2:])

    got = sorted((*pickle.loads(a), c, y) for a, c, *y in rows.select("about", "h", *own).mapInArrow(places, wide).collect())
    sizes = [len(c) // 4 for _, _, c, _ in got]
    cols = np.frombuffer(b"".join(c for _, _, c, _ in got), "<u4").astype(np.int64)
    folds = np.array([xxhash.xxh64_intdigest(k) % FOLDS for k, *_ in got])
    return train(chosen, np.repeat(np.arange(n), sizes), cols, np.array([x for _, x, _, _ in got]), np.array([y for *_, y in got], float), names, folds)


def scorer(chain: Chain | None):
    """A function from a text to the chain's probabilities; without a chain they are 0."""
    if chain is None:
        return lambda text: None
    columns, cache = chain.columns(), {}

    def score(text):
        nonlocal cache
        found, extra = read(text)
        cols: set[int] = set()
        for w in found:
            if (c := cache.get(w)) is None:
                if len(cache) >= CACHE:
                    cache = {}
                c = cache[w] = tuple(columns[h] for h in features(w) if h in columns)
            if c:
                cols.update(c)
        return chain.predict(sorted(cols), extra)

    return score


def score_toxicity(docs: DataFrame, chain: Chain | None, names: list[str], key: str = "doc_id", column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, p_<category>..., toxic) for each row; toxic: the last category's probability is at least the threshold.

    A null or empty text has no words and is judged on its shape alone, as any text is; one without a single letter is never toxic.
    Null keys, repeated rows and extra columns are no matter. Without a chain all probabilities are 0. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))

    def make():
        score = scorer(pickle.loads(model.value))

        def row(k, text):
            p = score(text) or [0.0] * len(names)
            return k, *p, p[-1] >= threshold and WORD.search(text or "") is not None

        return row

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, column], f"{key} {kind}, " + ", ".join(f"p_{n} double" for n in names) + ", toxic boolean", make)


def without_toxic(docs: DataFrame, chain: Chain | None, column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    small_batches(docs.sparkSession)
    model, at = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain)), docs.columns.index(column)

    def run(batches):
        score = scorer(pickle.loads(model.value))
        for b in batches:
            p = [score(x) for x in b.column(at).to_pylist()]
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array([not (q and q[-1] >= threshold and WORD.search(x or "") is not None) for q, x in zip(p, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: The categories that labels holds, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return score_toxicity(docs, chain, list(CATEGORIES))
