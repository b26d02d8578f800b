"""Embedding near-duplicates by product quantisation.

Equal vectors are made one first. The coarse lists are the cells of two codebooks, one for each half of the dimensions, so their
number grows with the table while the codebooks, like the codes of the residuals' subspaces, are fitted on a bounded sample. Every vector
is indexed: in the list of its nearest cell, with a code of SUBSPACES bytes and the length of what the code leaves out, and its code, not the
vector itself, visits the PROBES nearest cells. There each vector of the list is a query: asymmetric distances, looked up in tables of the
query's products with all code words, keep each code that can still lie within the threshold, given what it leaves out, so the codes lose no
pair; only probing can. The raw vectors of what was kept are then fetched once for each list and compared exactly, in double precision.

Lists are cut into blocks of at most about BLOCK vectors, and their visitors too, so one crowded place spreads over many tasks. A block
returns sums and the links of a spanning forest, never all its pairs; each pair is judged in exactly one block. Lengths of vectors are
indexed apart; those beyond the MOST_LENGTHS most frequent ones have a single list each.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import arrow_schema, batch, components, cut, lookup, small_batches, table

THRESHOLD = 0.9
#: Vectors that codebooks are fitted on, at most, for each of the MOST_LENGTHS most frequent lengths.
SAMPLE = 16_384
MOST_LENGTHS = 8
#: Vectors a list on average, and code words of a half at most: the lists are its square.
PER_LIST = 128
MOST_WORDS = 512
SUBSPACES = 8
CODES = 256
PROBES = 16
BLOCK = 8_192
#: Equal vectors that make up more than one of so many of all rows are looked up by broadcast.
HEAVY = 1_000
CELLS = 1 << 40


def kmeans(x: np.ndarray, k: int, steps: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].astype(np.float32).copy()
    x = x.astype(np.float32)
    for _ in range(steps):
        at = np.concatenate([np.argmin((c * c).sum(1) - 2 * (x[i : i + 4096] @ c.T), axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(at, x[:, d], len(c))
            c[n > 0, d] = (s[n > 0] / n[n > 0]).astype(np.float32)
    return c


class Quantiser:
    def __init__(self, x: np.ndarray, words: int):
        """x: a sample of unit vectors; words: code words of each half."""
        dim = x.shape[1]
        self.halves = np.array_split(np.arange(dim), min(2, dim))
        self.coarse = [kmeans(x[:, h], words) for h in self.halves]
        self.cuts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        cell = self.nearest(x, 1)[:, 0]
        r = x - self.centre(cell)
        self.books = [kmeans(r[:, c], CODES) for c in self.cuts]

    def split(self, cell: np.ndarray) -> list[np.ndarray]:
        """The code word of each half."""
        return [cell] if len(self.coarse) == 1 else [cell // len(self.coarse[1]), cell % len(self.coarse[1])]

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return np.concatenate([c[w] for c, w in zip(self.coarse, self.split(cell))], axis=1)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, in order: they lie among the n nearest words of each half."""
        cell, d = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
        for c, h in zip(self.coarse, self.halves):
            own = (c * c).sum(1) - 2 * (x[:, h].astype(np.float32) @ c.T)
            near = np.argsort(own, axis=1, kind="stable")[:, :n]
            d = (d[:, :, None] + np.take_along_axis(own, near, 1)[:, None, :]).reshape(len(x), -1)
            cell = (cell[:, :, None] * len(c) + near[:, None, :]).reshape(len(x), -1)
            first = np.argsort(d, axis=1, kind="stable")[:, :n]
            d, cell = np.take_along_axis(d, first, 1), np.take_along_axis(cell, first, 1)
        return cell

    def encode(self, x: np.ndarray, cell: np.ndarray):
        """Codes, the squared length of what they stand for, and the length of what they leave out."""
        r = (x - self.centre(cell)).astype(np.float32)
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        for m, (c, b) in enumerate(zip(self.cuts, self.books)):
            codes[:, m] = np.argmin((b * b).sum(1) - 2 * (r[:, c] @ b.T), axis=1)
        y = self.decode(cell, codes)
        return codes, (y * y).sum(1), np.linalg.norm(x - y, axis=1)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        y = self.centre(cell).astype(np.float64)
        for m, (c, b) in enumerate(zip(self.cuts, self.books)):
            y[:, c] += b[codes[:, m]]
        return y

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Products of each query with all code words: of the halves, then of the subspaces."""
        q = q.astype(np.float32)
        return [q[:, h] @ c.T for c, h in zip(self.coarse, self.halves)] + [q[:, c] @ b.T for c, b in zip(self.cuts, self.books)]

    def asymmetric(self, tables: list[np.ndarray], cell: np.ndarray, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Squared distances from each query to each code, by table lookup."""
        dot = np.zeros((len(tables[0]), len(cell)), np.float32)
        for t, w in zip(tables, [*self.split(cell), *codes.T]):
            dot += t.take(w, axis=1)
        return 1 + size[None, :] - 2 * dot


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unpack(cells: list[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1).astype(np.float64))


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, the smallest place of each part, after the parts of a and b are joined."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def close(v: np.ndarray, f: np.ndarray, lo: slice, among: slice, threshold: float) -> np.ndarray:
    """Which cosines reach the threshold, in double precision: single precision decides all that lie further from it than it can err."""
    s = f[lo] @ f[among].T
    err = 2.0**-23 * (v.shape[1] + 4)
    near = s >= threshold + err
    i, j = np.nonzero((s >= threshold - err) & ~near)
    if len(i):
        near[i, j] = np.einsum("ij,ij->i", v[lo][i], v[among][j]) >= threshold
    return near


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, and vectors of different lengths do not link;
    neither do rows with a null key, whose component is null and which are kept. Repeated rows are vectors of their
    own, linked with each other, and all are returned. Extra columns are no matter; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    e = F.col("e")
    single = isinstance(vectors.schema[column].dataType.elementType, FloatType)
    kind, held = ("<f4", "float") if single else ("<f8", "double")
    rows = vectors.select(F.col(key).alias("id"), F.transform(column, lambda v: v.cast(held) + F.lit(0.0).cast(held)).alias("e"))
    sound = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False)) & F.col("id").isNotNull()
    none = rows.filter(~sound).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    one = cut(rows.filter(sound).groupBy("e").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("m")))
    sizes = one.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(MOST_LENGTHS).collect()
    quantisers = {}
    for r in sizes:
        place = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30))
        few = one.filter((F.size("e") == r["d"]) & (place < int(min(1.0, 1.2 * SAMPLE / r["n"]) * (1 << 30))))
        x = np.array([y["e"] for y in few.orderBy(place, "rep").limit(SAMPLE).select("e").collect()], np.float64)
        if len(x):
            words = int(np.ceil(np.sqrt(r["n"] / PER_LIST) if r["d"] > 1 else r["n"] / PER_LIST))
            quantisers[r["d"]] = Quantiser(unit(x), max(1, min(MOST_WORDS, words, len(x) // 16 or 1)))
    known = spark.sparkContext.broadcast(pickle.dumps(quantisers))
    shown = "rep long, m long, v binary, list long, code binary, size float, rest float, probes array<long>"
    arrow = arrow_schema(shown)

    def index(batches):
        qs = pickle.loads(known.value)
        for b in batches:
            reps, m, v = np.array(b.column(0)), np.array(b.column(1)), b.column(2)
            d = np.diff(np.array(v.offsets))
            for n in np.unique(d):
                own = np.flatnonzero(d == n)
                raw = np.array(v.take(pa.array(own)).flatten()).astype(kind).reshape(len(own), n)
                if (q := qs.get(int(n))) is None:
                    at, codes, size, rest = np.zeros((len(own), 1), np.int64), np.zeros((len(own), 0), np.uint8), np.zeros(len(own)), np.zeros(len(own))
                else:
                    u = unit(raw.astype(np.float64))
                    at = q.nearest(u, PROBES)
                    codes, size, rest = q.encode(u, at[:, 0])
                at = at + int(n) * CELLS
                yield batch(arrow, reps[own], m[own], [r.tobytes() for r in raw], at[:, 0], [c.tobytes() for c in codes], size.astype(np.float32), rest.astype(np.float32), at.tolist())

    indexed = cut(one.select("rep", "m", "e").mapInArrow(index, shown))
    own = indexed.groupBy("list").agg(F.count("*").alias("own"))
    asked = indexed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("asked"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    cuts = own.join(asked, "list").select("list", blocks("own").alias("ni"), blocks("asked").alias("nq"))
    cuts = F.broadcast(cuts.filter("ni > 1 OR nq > 1"))  # of MOST_LENGTHS x MOST_WORDS^2 lists at most, and one for each other length
    spread = lambda c: F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1)
    part = lambda c: F.pmod(F.xxhash64("rep"), F.coalesce(c, F.lit(1))).cast("int")
    ni, nq = F.col("ni"), F.col("nq")
    code = ("rep", "home", "code", "size", "rest")
    members = indexed.withColumn("home", F.col("list")).join(cuts, "list", "left").withColumns({"bi": part(ni), "bq": F.explode(spread(nq))})
    visits = indexed.withColumnRenamed("list", "home").withColumn("list", F.explode(F.slice("probes", 2, PROBES))).join(cuts, "list", "left").withColumns({"bq": part(nq), "bi": F.explode(spread(ni))})
    asks = members.select("list", "bi", "bq", *code, "v").unionByName(visits.select("list", "bi", "bq", *code, F.lit(None).cast("binary").alias("v")))
    # codes of a list's own vectors are asked for by block, like visitors
    mates = members.filter((F.col("bq") == 0) & (ni > 1)).drop("bi", "bq").withColumns({"bq": part(nq), "own": part(ni)}).withColumn("bi", F.explode(spread(ni))).filter("bi <> own")
    asks = asks.unionByName(mates.select("list", "bi", "bq", *code, F.lit(None).cast("binary").alias("v")))
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    kept_shape = "list long, rep long"
    kept_arrow = arrow_schema(kept_shape)

    def keep(t: pa.Table) -> pa.Table:
        """The vectors of a block that may have a partner in it: queries and codes alike."""
        at, reps = t.column("list")[0].as_py(), np.array(t.column("rep"))
        q = pickle.loads(known.value).get(at // CELLS)
        if q is None:
            return pa.Table.from_batches([batch(kept_arrow, np.full(len(reps), at), reps)], kept_arrow)
        asks = np.array(t.column("v").is_valid())
        v = unpack(t.column("v").filter(pa.array(asks)).to_pylist(), kind) if asks.any() else np.zeros((0, at // CELLS))
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(reps), -1)
        home, size = np.array(t.column("home")) % CELLS, np.array(t.column("size"))
        reach = (far + np.array(t.column("rest")) + 1e-3) ** 2
        ids, hit = reps[asks], np.zeros(len(reps), bool)
        place = np.flatnonzero(asks)
        for lo in range(0, len(v), 512):
            near = q.asymmetric(q.tables(v[lo : lo + 512]), home, codes, size) <= reach[None, :]
            near &= ids[lo : lo + 512, None] != reps[None, :]
            hit |= near.any(axis=0)
            hit[place[lo : lo + 512]] |= near.any(axis=1)
        got = np.unique(reps[hit])
        return pa.Table.from_batches([batch(kept_arrow, np.full(len(got), at), got)], kept_arrow)

    kept = asks.groupBy("list", "bi", "bq").applyInArrow(keep, kept_shape).distinct()
    raw = indexed.select("rep", "m", "v", F.col("list").alias("home"), "probes")
    fetched = kept.join(raw, "rep").join(cuts.select("list", "ni"), "list", "left").withColumn("visits", F.col("list") != F.col("home"))
    fetched = fetched.withColumns({"b": F.when(F.col("visits"), -1).otherwise(part(ni)), "o": F.explode(spread(ni))})
    fetched = fetched.withColumns({"bi": F.when(F.col("visits"), F.col("o")).otherwise(F.least("b", "o")), "bj": F.when(F.col("visits"), F.col("o")).otherwise(F.greatest("b", "o"))})
    out_shape = "rep long, links long, low long"
    out_arrow = arrow_schema(out_shape)

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("visits", "ascending"), ("rep", "ascending")])
        at, bi, bj = (t.column(c)[0].as_py() for c in ("list", "bi", "bj"))
        b, reps, m, home = (np.array(t.column(c)) for c in ("b", "rep", "m", "home"))
        n = int((b >= 0).sum())  # the list's own come first
        v = unpack(t.column("v").to_pylist(), kind)
        f = v.astype(np.float32)
        probes = [np.array(p) for p in t.column("probes").slice(0, n).to_pylist()]
        # a pair from two lists that ask each other is judged in the list with the smaller number
        mutual = {h: np.array([h in p for p in probes], bool) for h in np.unique(home[n:]) if h < at}
        links, label, weight = np.zeros(len(reps)), np.arange(len(reps)), m.astype(np.float64)
        for lo in range(0, n, 512):
            i = slice(lo, min(lo + 512, n))
            near = close(v, f, i, slice(0, len(reps)), threshold)
            k = np.arange(i.start, i.stop)
            near[:, :n] &= np.arange(n)[None, :] > k[:, None]
            if bi != bj:
                near[:, :n] &= b[i, None] != b[None, :n]
            for h, x in mutual.items():
                near[:, n:][np.ix_(x[i], home[n:] == h)] = False
            links[i] += near @ weight
            links += weight[i] @ near
            x, y = np.nonzero(near)
            label = forest(label, x + lo, y)
        hit = np.flatnonzero(links)
        return pa.Table.from_batches([batch(out_arrow, reps[hit], links[hit].astype(np.int64), reps[label[hit]])], out_arrow)

    found = cut(fetched.select("list", "bi", "bj", "b", "visits", "rep", "m", "v", "home", "probes").groupBy("list", "bi", "bj").applyInArrow(compare, out_shape))
    parts = components(found, "rep", "low")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    about = one.join(sums, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    about = about.select("e", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    key_kind = vectors.schema[key].dataType
    total = one.agg(F.sum("m")).first()[0] or 0
    joined = lookup(rows.filter(sound), about, "e", F.col("m") > max(HEAVY, total // HEAVY), HEAVY)
    joined = joined.select(F.col("id").alias(key), "n_links", F.col("component_id").cast(key_kind).alias("component_id"))
    return joined.withColumn("kept", F.col(key) == F.col("component_id")).unionByName(none)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
