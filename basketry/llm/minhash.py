"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are SHINGLE words; a shingle's weight is its count times a smoothed inverse document frequency in [1, 2]: 1 if all documents hold it, 2 if at
most one in RARE does, and in between by the logarithm. So a weight hangs on the share of documents and not on how many there are. The shares
come from counts over all documents in two hash tables, from which what rare shingles put into every bucket is taken off; as at most RARE times
the mean length of shingles are not rare, however many documents there are, the tables need not grow. A rare shingle gets a smaller weight only if
it meets a frequent one in both tables. Each document draws HASHES samples, such that two
documents draw the same one with the probability of their weighted Jaccard similarity; ROWS samples make a band, and documents
that agree in a band are compared exactly, by their weighted shingles. THRESHOLD or more is a link; classes are connected components.

Texts with the same words are made one first. In each band's bucket every text is compared with the bucket's first; most buckets then
lie in one class. Where one does not, its texts are laid out in blocks of about BLOCK and each pair of blocks goes to some task, so no
crowded bucket falls to a single one. There all pairs are compared at once: the weights that two texts share are a product of two matrices, over the
shingles that stand in more than one text of the blocks, and only pairs that lie at the threshold are summed up one by one.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch, components, cut, gathered, mix, small_batches, table

SHINGLE = 5
THRESHOLD = 0.8
HASHES, ROWS = 36, 3
BUCKETS = 1 << 20
RARE = 256
GRAIN = 1 << 14
BLOCK = 1_024
#: Columns of a matrix at once, and how far from the threshold single precision decides.
WIDE = 4_096
EDGE = 1e-3
CHUNK = 2_048
SHARE = 2_048
CACHE = 300_000
WORD = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


class Shingler:
    def __init__(self, df: np.ndarray | None = None, n: int = 0):
        self.words = Hashes()
        if df is not None:
            halves = df.reshape(2, -1).astype(np.float64)
            noise = np.median(halves, axis=1, keepdims=True)
            share = np.clip((halves - noise - 4 * np.sqrt(noise)) / max(1, n), 1 / RARE, 1)
            self.idf = (1 - np.log(share) / np.log(RARE)).astype(np.float32).ravel()

    def ids(self, text: str) -> np.ndarray:
        w = WORD.findall(text.lower())
        return np.fromiter(map(self.words.__getitem__, w), np.uint64, len(w))

    def shingles(self, ids: np.ndarray):
        """Distinct shingles in order, and how often each occurs; a text of fewer words is one shingle, one without words has none."""
        n = len(ids)
        if not n:
            return ids, np.zeros(0, np.int64)
        k = min(SHINGLE, n)
        h = ids[: n - k + 1].copy()
        for j in range(1, k):
            h = h * ODD + ids[j : n - k + 1 + j]
        return np.unique(mix(h + np.uint64(k)), return_counts=True)

    def weight(self, h: np.ndarray) -> np.ndarray:
        a, b = buckets(h)
        return np.maximum(self.idf[a], self.idf[b])

    def weighted(self, text: str):
        h, tf = self.shingles(self.ids(text))
        return h, tf * self.weight(h)


_HELD: list = [None, None]


def shingler(df) -> Shingler:
    """The Shingler of a broadcast, made once in each worker: its table of weights takes longer than many a group of rows."""
    v = df.value
    if _HELD[0] is not v:
        _HELD[:] = [v, Shingler(*v)]
    return _HELD[1]


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's place in either table; the tables stand one behind the other."""
    half = BUCKETS // 2
    return (h >> np.uint64(45)).astype(np.int64), (h >> np.uint64(20) & np.uint64(half - 1)).astype(np.int64) + half


class Sampler:
    """Draws for each hash the shingle with the smallest ln a = ln c - r (t - beta) - r, where t = floor(ln w / r + beta); r and c are Gamma(2, 1) and beta is
    uniform, all taken from the shingle's hash by tables of GRAIN quantiles."""

    def __init__(self):
        u = (np.arange(GRAIN) + 0.5) / GRAIN
        x = np.linspace(0, 40, 400_001)
        gamma = np.interp(u, 1 - (1 + x) * np.exp(-x), x)
        self.r, self.inverse = gamma.astype(np.float32), (1 / gamma).astype(np.float32)
        self.c, self.beta = np.log(gamma).astype(np.float32), u.astype(np.float32)
        rng = np.random.default_rng(1)
        self.seeds = (rng.integers(1, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)

    def draw(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        best, out = np.full(HASHES, np.inf, np.float32), np.zeros(HASHES, np.uint64)
        every, low = np.arange(HASHES), np.uint64(GRAIN - 1)
        for i in range(0, len(h), CHUNK):
            own, logs = h[i : i + CHUNK], np.log(w[i : i + CHUNK]).astype(np.float32)
            u = own[None, :] * self.seeds[:, None]
            u ^= u >> np.uint64(31)
            u *= ODD
            a = (u >> np.uint64(50)).astype(np.int32)
            r, b = self.r[a], self.beta[((u >> np.uint64(36)) & low).astype(np.int32)]
            t = np.floor(logs[None, :] * self.inverse[a] + b)
            v = self.c[((u >> np.uint64(22)) & low).astype(np.int32)] - r * (t - b + 1)
            at = v.argmin(axis=1)
            low_v = v[every, at]
            better = low_v < best
            best = np.where(better, low_v, best)
            out = np.where(better, mix(own[at] + (t[every, at].astype(np.int64) + 1000).astype(np.uint64) * ODD), out)
        return out

    def bands(self, draws: np.ndarray) -> np.ndarray:
        s = draws.reshape(-1, ROWS)
        out = np.arange(len(s), dtype=np.uint64)
        for j in range(ROWS):
            out = mix(out * ODD + s[:, j])
        return out.view(np.int64)


def similarity(a, b) -> float:
    """Weighted Jaccard of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low, high = np.minimum(a[1][i], b[1][j]).sum(), np.maximum(a[1][i], b[1][j]).sum()
    total = high + (a[1].sum() - a[1][i].sum()) + (b[1].sum() - b[1][j].sum())
    return float(low / total) if total > 0 else 0.0


def similarities(s: Shingler, sets: list, left: slice, right: slice) -> np.ndarray:
    """Weighted Jaccard similarities of texts on the left with texts on the right. A shingle that a text holds k times is k features of one weight."""
    hashes, rows = [], []
    for i, (h, w) in enumerate(sets):
        tf = np.rint(w / s.weight(h)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
        level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        h = np.repeat(h, tf)
        hashes.append(np.where(level == 0, h, mix(h + level.astype(np.uint64) * ODD)))
        rows.append(np.column_stack([np.full(len(h), i), np.arange(len(h))]))
    total = np.array([w.sum() for _, w in sets], np.float32)
    weights = np.concatenate([np.repeat(s.weight(h), np.rint(w / s.weight(h)).astype(np.int64)) if len(h) else np.zeros(0, np.float32) for h, w in sets])
    row = np.concatenate(rows)[:, 0]
    _, first, place, n = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True, return_counts=True)
    common = n > 1
    column = (np.cumsum(common) - 1)[place]
    row, column, weight = row[common[place]], column[common[place]], weights[first][common]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    for lo in range(0, len(weight), WIDE):
        i, j = np.searchsorted(column, [lo, lo + WIDE])
        m = np.zeros((len(sets), min(WIDE, len(weight) - lo)), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        shared += (m[left] * weight[lo : lo + WIDE]) @ m[right].T
    whole = total[left][:, None] + total[right][None, :] - shared
    return np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0)


def document_frequencies(docs: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Documents for each bucket of shingles, over all documents, and how many documents there are. Tasks send what they counted, added up in a tree."""
    small_batches(docs.sparkSession)

    def run(batches):
        s, df, n = Shingler(), np.zeros(BUCKETS, np.int32), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                for at in buckets(s.shingles(s.ids(text or ""))[0]):
                    df[np.unique(at)] += 1
        yield pa.RecordBatch.from_pydict({"s": pa.array([pack(df, n)], pa.binary())})

    def pack(df, n):
        at = np.flatnonzero(df).astype(np.int32)
        body = (at.tobytes() + df[at].tobytes()) if len(at) < BUCKETS // 2 else df.tobytes()
        return pickle.dumps((n, len(at), zlib.compress(body, 1)))

    def unpack(s):
        n, k, body = pickle.loads(s)
        x = np.frombuffer(zlib.decompress(body), np.int32)
        df = np.zeros(BUCKETS, np.int32)
        if len(x) == BUCKETS and k >= BUCKETS // 2:
            return x, n
        df[x[:k]] = x[k:]
        return df, n

    def merge(a, b):
        (x, n), (y, m) = unpack(a), unpack(b)
        return pack(x + y, n + m)

    parts = docs.select(column).mapInArrow(run, "s binary").rdd.map(lambda r: bytes(r[0]))
    whole = gathered(parts, merge)
    return unpack(whole) if whole is not None else (np.zeros(BUCKETS, np.int32), 0)


def near_duplicates(docs: DataFrame, key: str = "doc_id", column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, kept) for each row: the smallest key of its class, and whether it is the row's own.

    Null and empty texts and texts without words are alike only to themselves; so are rows with a null key, whose class is null and
    which are kept. Rows with the same key are one document. Copies of one text share a class; repeated rows are all returned.
    Extra columns are no matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts, n = document_frequencies(docs, column)
    df = spark.sparkContext.broadcast((counts, n))  # BUCKETS numbers, whatever the input
    shape = "id long, digest binary, bands array<long>"
    arrow = arrow_schema(shape)

    def sign(batches):
        s, draw = shingler(df), Sampler()
        for b in batches:
            ks, digests, bands = b.column(0), [], []
            for text in b.column(1).to_pylist():
                ids = s.ids(text or "")
                if len(ids):
                    h, tf = s.shingles(ids)
                    digests.append(xxhash.xxh128_digest(ids.tobytes()))
                    bands.append(draw.bands(draw.draw(h, tf * s.weight(h))))
                else:
                    digests.append(None)
                    bands.append(None)
            yield batch(arrow, ks, digests, bands)

    d = docs.select(F.col(key).cast("long").alias("id"), F.col(column).alias("text"))
    signed = cut(d.mapInArrow(sign, shape))
    some = F.col("digest").isNotNull() & F.col("id").isNotNull()
    reps = cut(signed.filter(some).groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    firsts = members.groupBy("bucket").agg(F.min("rep").alias("first"), F.count("*").alias("size")).filter("size > 1")
    members = cut(members.join(firsts, "bucket").select("bucket", "rep", "first", "size"))
    texts = d.filter("id IS NOT NULL").select("id", "text")
    mates = members.filter("rep <> first").groupBy("rep", "first").agg(F.max("size").alias("size"))
    linked = _verify(mates, texts, df, threshold)
    members = members.select("bucket", "rep")
    label = components(linked, "rep", "first")
    # buckets that hold several classes still
    named = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("part"))
    mixed = named.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"))
    rest = cut(named.join(mixed, "bucket"))
    if not rest.isEmpty():
        linked = cut(linked.unionByName(_verify_blocks(rest, texts, df, threshold)))
        label = components(linked, "rep", "first")
    named = reps.select("digest", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
    kind = docs.schema[key].dataType
    out = signed.select("id", "digest").join(named, "digest", "left").select(F.col("id").cast(kind).alias(key), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).cast(kind).alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True)))


def _verify(mates: DataFrame, texts: DataFrame, df, threshold: float) -> DataFrame:
    """The pairs (rep, first) whose texts are similar enough. The first of a large bucket is sent in as many copies as there are SHARE of its mates."""
    parts = F.ceil(F.col("size") / SHARE).cast("int")
    salted = mates.withColumn("salt", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    firsts = mates.groupBy("first").agg(F.max(parts).alias("n")).join(texts.select(F.col("id").alias("first"), F.col("text").alias("t2")), "first")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    both = salted.join(texts.select(F.col("id").alias("rep"), F.col("text").alias("t1")), "rep").join(firsts, ["first", "salt"])
    arrow = arrow_schema("rep long, first long")

    def run(batches):
        s, was, own = shingler(df), None, None
        for b in batches:
            keep = []
            for f, x, y in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if f != was:
                    was, own = f, s.weighted(y or "")
                keep.append(similarity(s.weighted(x or ""), own) >= threshold)
            yield batch(arrow, b.column(0), b.column(1)).filter(pa.array(keep, pa.bool_()))

    return cut(both.select("rep", "first", "t1", "t2").mapInArrow(run, "rep long, first long"))


def _verify_blocks(rest: DataFrame, texts: DataFrame, df, threshold: float) -> DataFrame:
    """Links between texts of different classes in one bucket; each pair of blocks is a group, and a group returns a spanning forest's links."""
    at = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    cols = ("b", "rep", "part")
    placed = rest.withColumn("b", at).join(texts.withColumnRenamed("id", "rep"), "rep").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = placed.select("bucket", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), *cols, "text")
    arrow = arrow_schema("rep long, first long")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("b", "ascending"), ("rep", "ascending")])
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        b, reps, parts = (np.array(t.column(c)) for c in ("b", "rep", "part"))
        s, texts = shingler(df), t.column("text")
        left = slice(0, int((b == bi).sum()))
        right = slice(left.stop if bi != bj else 0, len(b))
        if (parts == parts[0]).all():
            return arrow.empty_table()
        sets = [s.weighted(texts[i].as_py() or "") for i in range(len(b))]
        sim = similarities(s, sets, left, right)
        near = (sim >= threshold - EDGE) & (parts[left][:, None] != parts[right][None, :])
        if bi == bj:
            near &= reps[left][:, None] < reps[right][None, :]
        x, y = np.nonzero(near)
        order = np.argsort(-sim[x, y], kind="stable")
        root = {p: p for p in parts.tolist()}

        def find(p):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        out = ([], [])
        for i, j, sure in zip((x[order] + left.start).tolist(), (y[order] + right.start).tolist(), (sim[x, y][order] >= threshold + EDGE).tolist()):
            p, q = find(int(parts[i])), find(int(parts[j]))
            if p != q and (sure or similarity(sets[i], sets[j]) >= threshold):
                root[max(p, q)] = min(p, q)
                out[0].append(int(reps[j]))
                out[1].append(int(reps[i]))
        return pa.Table.from_batches([batch(arrow, *out)], arrow)

    return rows.groupBy("bucket", "bi", "bj").applyInArrow(run, "rep long, first long")


def one_of_each(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row of each class, with all its columns; rows with a null key all stay. Of rows with one key, which are one document, the text with the smallest hash stays."""
    kept = near_duplicates(docs, key, column).filter("kept").filter(F.col(key).isNotNull()).select(F.col(key).alias("_kept")).distinct()
    found = docs.filter(F.col(key).isNotNull()).join(kept, F.col(key) == F.col("_kept"), "left_semi")
    by = F.xxhash64(column, *(f.name for f in docs.schema if "map<" not in f.dataType.simpleString()))
    one = found.groupBy(F.col(key).alias("_kept")).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(column), by)).alias("_row")).select("_row.*")
    return one.unionByName(docs.filter(F.col(key).isNull()))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
