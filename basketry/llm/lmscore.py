"""Language-model scores by the likelihood of a subword lattice.

A text is a sequence of pieces drawn one by one, and an end. Words of the text, put in lower case (A-Z), each start with a mark, so no
piece crosses from one word into the next, and the marginal probability of a text is the product over its words of the sum over all
segmentations, by a forward recursion in log space. The pieces and their first scores are those of an existing vocabulary: log
probabilities of a unigram model, or, where the scores of a merge vocabulary are ranks, Zipf's law over them. EM steps over the words
of the training texts then fit them to the corpus, until the held-out words' likelihood rises no more. A character that is no piece is spelled in bytes.

Distinct words are counted once for the whole corpus, their lattices built once, and each step runs over the lattices in arrays. Texts look frequent words up in a broadcast table of at
most FREQUENT words of at most FREQUENT_BYTES bytes; the others are joined through a shuffle, in which no key can be hot, as every hot word is in the table.
"""

from __future__ import annotations

import math
import pickle
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch, cut, gathered, small_batches, table

FREQUENT = 200_000
FREQUENT_BYTES = 64
HELD = 400_000
#: EM steps at most; they end when a step raises the held-out words' mean log10 probability by less than RISE.
EM_STEPS = 12
RISE = 0.002
#: Words of more letters, and words with a letter that is no piece, are read one by one.
SHORT = 48
TOGETHER = 4_096
PRIOR = 1_000.0
MARK = "▁"
LOG10 = math.log(10)


def held_out(doc_id) -> bool:
    """Whether a document is kept from training; a null id counts as empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class Vocabulary:
    """Pieces and their probabilities: probs[i] of pieces[i], then 256 bytes, then the end."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.pieces = [sp.id_to_piece(i) for i in plain]
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        scores = np.array([sp.get_score(i) for i in plain])
        ranks = np.all(scores == np.round(scores))
        p = 1 / (10 - scores) if ranks else np.exp(scores)
        self.widths = np.array([len(x) for x in self.pieces])
        p = 0.99 * p / p.sum()
        self.probs = np.concatenate([p, np.full(256, 0.005 / 256), [0.005]])


class Lattice:
    def __init__(self, v: Vocabulary, probs: np.ndarray):
        logs = np.log(probs)
        self.index, self.longest, self.n = v.index, v.longest, len(v.pieces)
        self.logs = dict(zip(v.pieces, logs.tolist()))
        self.bytes, self.end = logs[self.n : -1].tolist(), float(logs[-1])

    def spelled(self, c: str) -> float:
        return sum(self.bytes[b] for b in c.encode())

    def forward(self, word: str) -> float:
        """The log probability of a word over all its segmentations."""
        s, logs, most = MARK + word, self.logs, self.longest
        get, exp, log = logs.get, math.exp, math.log
        a = [0.0]
        for i in range(1, len(s) + 1):
            best = top = a[i - 1] + self.spelled(s[i - 1]) if s[i - 1] not in logs else -math.inf
            terms = []
            for j in range(max(0, i - most), i):
                x = get(s[j:i])
                if x is not None:
                    x += a[j]
                    terms.append(x)
                    if x > top:
                        top = x
            total = exp(best - top) if best > -math.inf else 0.0
            for x in terms:
                total += exp(x - top)
            a.append(top + log(total))
        return a[-1]

    def expected(self, word: str, weight: float, counts: list[float]) -> None:
        """Adds the expected number of uses of each piece in a word that is seen weight times."""
        s, get, most, index, n = MARK + word, self.logs.get, self.longest, self.index, self.n
        size = len(s)
        a, edges = [0.0], []
        for i in range(1, size + 1):
            own = []
            for j in range(max(0, i - most), i):
                p = s[j:i]
                x = get(p)
                if x is not None:
                    own.append((j, x, index[p]))
            if s[i - 1] not in self.logs:
                own.append((i - 1, self.spelled(s[i - 1]), -1))
            top = max(a[j] + x for j, x, _ in own)
            a.append(top + math.log(sum(math.exp(a[j] + x - top) for j, x, _ in own)))
            edges.append(own)
        g = [0.0] * size + [weight]  # the expected number of paths through each border
        for i in range(size, 0, -1):
            if g[i] <= 0.0:
                continue
            for j, x, k in edges[i - 1]:
                f = g[i] * math.exp(a[j] + x - a[i])
                g[j] += f
                if k >= 0:
                    counts[k] += f
                else:
                    for b in s[i - 1].encode():
                        counts[n + b] += f


class Lattices:
    """The lattices of many short words, each letter of which is a piece. Nodes are the words' borders, one word behind the other; edges are pieces."""

    def __init__(self, v: Vocabulary, raw: bytes):
        """raw: from pack()."""
        words, total = np.frombuffer(raw, "<u4", 2)
        sizes = np.frombuffer(raw, "u1", words, 8).astype(np.int64)
        self.into = np.frombuffer(raw, "u1", total, 8 + words).astype(np.int64)  # edges that end at each border but a word's first
        self.piece = np.frombuffer(raw, "<u2", -1, 8 + words + total).astype(np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.last = self.first + sizes
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        node = np.repeat(self.first, sizes) + place
        by = np.argsort(place, kind="stable")
        edge = np.cumsum(self.into) - self.into
        self.into = self.into[by]
        order = np.repeat(edge[by] - np.cumsum(self.into) + self.into, self.into) + np.arange(len(self.piece))
        self.piece = self.piece[order]
        self.node = node[by]
        self.end = np.repeat(self.node, self.into)
        self.start = self.end - v.widths[self.piece]
        n = np.cumsum(np.bincount(place))
        self.steps = list(zip(n[:-1].tolist(), n[1:].tolist()))  # borders by their place in the word
        self.edges = np.concatenate([[0], np.cumsum(self.into)])

    @staticmethod
    def pack(v: Vocabulary, words: list[str]) -> bytes:
        get, most, into, out = v.index.get, v.longest, [], []
        for s in words:
            for i in range(1, len(s) + 1):
                own = [k for j in range(i - most if i > most else 0, i) if (k := get(s[j:i])) is not None]
                into.append(len(own))
                out += own
        return np.array([len(words), len(into)], "<u4").tobytes() + bytes(map(len, words)) + bytes(into) + np.array(out, "<u2").tobytes()

    def forward(self, logs: np.ndarray):
        """The log probability of reaching each border, over all segmentations, and of each edge with all that leads to it."""
        a, x = np.zeros(self.last[-1] + 1), logs[self.piece]
        for lo, hi in self.steps:
            e, f = self.edges[lo], self.edges[hi]
            y = x[e:f]
            y += a[self.start[e:f]]
            at, n = self.edges[lo:hi] - e, self.into[lo:hi]
            top = np.maximum.reduceat(y, at)
            a[self.node[lo:hi]] = top + np.log(np.add.reduceat(np.exp(y - np.repeat(top, n)), at))
        return a, x

    def expected(self, a: np.ndarray, x: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Expected uses of each piece in words that are seen so often."""
        share = np.exp(x - a[self.end])
        g = np.zeros(len(a))  # the expected number of paths through each border
        g[self.last] = weights
        for lo, hi in reversed(self.steps):
            e, f = self.edges[lo], self.edges[hi]
            share[e:f] *= g[self.end[e:f]]
            g[self.start[e:f]] += share[e:f]  # edges that end at one border start at different ones
        return np.bincount(self.piece, share, n)


def word_counts(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(word, n, c): how often each word occurs in all texts, and in training texts. Tasks add up before the shuffle."""
    small_batches(docs.sparkSession)
    schema = "word binary, n long, c long"
    arrow = arrow_schema(schema)

    def run(batches):
        counts = (Counter(), Counter())
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[held_out(k)].update((text or "").encode().lower().split())
            if sum(map(len, counts)) > HELD:
                yield from flush(counts)
        yield from flush(counts)

    def flush(counts):
        for c, train in zip(counts, (1, 0)):
            n = list(c.values())
            yield batch(arrow, list(c), n, n if train else [0] * len(n))
            c.clear()

    parts = docs.select(key, column).mapInArrow(run, schema)
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def lattices(counts: DataFrame, v: Vocabulary) -> DataFrame:
    """(words, n, c, pack): words with their counts, and their lattices where they are short and spelled in pieces; else pack is null."""
    small_batches(counts.sparkSession)
    known = counts.sparkSession.sparkContext.broadcast(pickle.dumps(v))
    schema = "words array<binary>, n array<long>, c array<long>, pack binary"
    arrow = arrow_schema(schema)

    def run(batches):
        v, held, odd = pickle.loads(known.value), [], []
        letters = {p for p in v.pieces if len(p) == 1}

        def flush(rows, plain):
            ws, ns, cs, texts = zip(*rows)
            rows.clear()
            return batch(arrow, [list(ws)], [list(ns)], [list(cs)], [zstandard.compress(Lattices.pack(v, texts), 3) if plain else None])

        for b in batches:
            for w, n, c in zip(*(x.to_pylist() for x in b.columns)):
                s = MARK + w.decode("utf-8", "replace")
                plain = len(s) <= SHORT and letters.issuperset(s) and len(v.pieces) < 1 << 16
                (held if plain else odd).append((w, n, c, s))
            if len(held) >= TOGETHER:
                yield flush(held, True)
            if len(odd) >= TOGETHER:
                yield flush(odd, False)
        if held:
            yield flush(held, True)
        if odd:
            yield flush(odd, False)

    return counts.select("word", "n", "c").mapInArrow(run, schema)


def step(built: DataFrame, v: Vocabulary, probs: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Expected uses of pieces and bytes in training words; the held-out words' log10 probability, and their number."""
    known = built.sparkSession.sparkContext.broadcast(pickle.dumps((v, probs)))

    def run(batches):
        v, probs = pickle.loads(known.value)
        lattice, logs, out = Lattice(v, probs), np.log(probs), np.zeros(len(probs) + 2)
        for b in batches:
            for words, n, c, pack in zip(*(x.to_pylist() for x in b.columns)):
                c, rest = np.array(c, np.float64), np.array(n, np.float64) - np.array(c)
                if pack is None:
                    texts = [w.decode("utf-8", "replace") for w in words]
                    lm, own = np.array([lattice.forward(w) for w in texts]), [0.0] * len(probs)
                    for w, k in zip(texts, c.tolist()):
                        if k:
                            lattice.expected(w, k, own)
                    out[:-2] += own
                else:
                    many = Lattices(v, zstandard.decompress(pack))
                    a, x = many.forward(logs)
                    out[:-2] += many.expected(a, x, c, len(probs))
                    lm = a[many.last]
                out[-2:] += rest @ lm / LOG10, rest.sum()
        yield pa.RecordBatch.from_pydict({"s": pa.array([out.tobytes()], pa.binary())})

    parts = built.mapInArrow(run, "s binary").rdd.map(lambda r: bytes(r[0]))
    add = lambda x, y: (np.frombuffer(x) + np.frombuffer(y)).tobytes()
    whole = gathered(parts, add)
    total = np.frombuffer(whole) if whole is not None else np.zeros(len(probs) + 2)
    return total[:-2], float(total[-2]), int(total[-1])


def fit(built: DataFrame, v: Vocabulary, docs: int, steps: int = EM_STEPS) -> np.ndarray:
    """Probabilities of the pieces, bytes and the end, by EM over the words of training texts, each weighted by its count; the ones that held-out words liked best."""
    probs, best, least = v.probs, v.probs, -math.inf
    for _ in range(steps + 1):
        uses, held, n = step(built, v, probs)
        mean = held / max(1, n)
        if mean > least:
            best = probs
        if mean < least + RISE:
            break
        least = mean
        uses = uses + PRIOR * v.probs
        uses[-1] += docs
        probs = uses / uses.sum()
    return best


def frequent_bar(words: DataFrame, most: int) -> float:
    """The smallest bound such that at most so many words are seen as often; from a histogram of 32 classes to each doubling."""
    place = F.floor(F.log2("n") * 32)
    rows = words.filter(F.length("word") <= FREQUENT_BYTES).groupBy(place.alias("k")).count().orderBy(F.desc("k")).limit(64 * 32).collect()
    bar, total = math.inf, 0
    for r in rows:
        total += r["count"]
        if total > most:
            break
        bar = r["k"]
    return bar


def score_texts(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text", steps: int = EM_STEPS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    A null or empty text is one token, the end. A row with a null key counts as one with an empty key. Repeated rows are all counted
    and all returned. Extra columns are no matter; an empty table gives no rows. Long texts and words are taken whole.
    """
    spark = docs.sparkSession
    v = Vocabulary(path)
    counts = cut(word_counts(docs, key, column))
    built = cut(lattices(counts, v))
    ends = docs.select(key).groupBy((F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("h")).count().collect()
    trained = sum(r["count"] for r in ends if not r["h"])
    sums = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, distinct = (sums["n"] or 0) + trained, sums["v"] + (trained > 0)
    probs = fit(built, v, trained, steps)
    known = spark.sparkContext.broadcast(pickle.dumps((v, probs)))
    room = math.log10(n + distinct + 1)

    shown = "word binary, n long, known boolean, base double, lm double"
    out = arrow_schema(shown)

    def marginals(batches):
        v, probs = pickle.loads(known.value)
        lattice, logs = Lattice(v, probs), np.log(probs)
        for b in batches:
            for ws, ns, cs, pack in zip(*(x.to_pylist() for x in b.columns)):
                if pack is None:
                    lm = [lattice.forward(w.decode("utf-8", "replace")) / LOG10 for w in ws]
                else:
                    many = Lattices(v, zstandard.decompress(pack))
                    lm = many.forward(logs)[0][many.last] / LOG10
                yield batch(out, ws, ns, [c > 0 for c in cs], [math.log10(c + 1) - room for c in cs], lm)

    words = cut(built.mapInArrow(marginals, shown))
    bar = frequent_bar(words, FREQUENT)
    top = words.filter((F.length("word") <= FREQUENT_BYTES) & (F.floor(F.log2("n") * 32) >= bar)).select("word", "known", "base", "lm").toArrow()  # FREQUENT rows at most
    packed = spark.sparkContext.broadcast(pickle.dumps([c.to_pylist() if i == 0 else np.array(c) for i, c in enumerate(top.columns)]))
    del top
    end_base, end_lm = math.log10(trained + 1) - room, float(math.log(probs[-1])) / LOG10
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, h long, word binary, tf long, rows long, n_tokens long, n_known long, base double, lm double"
    arrow = arrow_schema(schema)

    def look_up(batches):
        ws, known, base, lm = pickle.loads(packed.value)
        get = {w: i for i, w in enumerate(ws)}.get
        del ws
        for b in batches:
            cols = [[] for _ in arrow]
            for k, h, text in zip(*(c.to_pylist() for c in b.columns)):
                got = (text or "").encode().lower().split()
                at = list(map(get, got))
                if None in at:
                    rare = Counter(w for w, i in zip(got, at) if i is None)
                    at = [i for i in at if i is not None]
                else:
                    rare = {}
                at = np.array(at, np.int64)
                # no word holds a space: a text's own row meets no word, and its key, the row's hash, puts it anywhere, and in the same place again when a task is run again
                rows = [(k, h, struct.pack("<cq", b" ", h), 0, 1, len(got) + 1, int(known[at].sum()) + (trained > 0), math.fsum(base[at]) + end_base, math.fsum(lm[at]) + end_lm)]
                rows += [(k, h, w, c, 0, 0, 0, 0.0, 0.0) for w, c in rare.items()]
                for c, x in zip(cols, zip(*rows)):
                    c += x
            yield batch(arrow, *cols)

    small_batches(spark)
    keyed = docs.select(key, F.xxhash64(key, column, F.col(column).isNull()).alias("h"), column)
    rows = keyed.mapInArrow(look_up, schema)
    rest = words.select("word", F.col("known").cast("long").alias("_k"), F.col("base").alias("_b"), F.col("lm").alias("_l"))
    total = lambda own, joined: (F.sum(F.col(own) + F.col("tf") * F.coalesce(joined, F.lit(0)))).alias(own)
    out = rows.join(rest, "word", "left").groupBy(key, "h").agg(F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), total("n_known", "_k"), total("base", "_b"), total("lm", "_l"))
    each = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select(
        key, (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out"), F.expr("n_tokens div rows").alias("n_tokens"), F.expr("n_known div rows").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("lm") / F.col("rows")).alias("score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
