"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders; a capitalised word that starts a sentence is read both as itself and as a name. Windows of WINDOW words of the templates are hashed and joined with the windows
of the benchmark. A document that holds SHARE or more of an item's windows, in places whose slots fit, is contaminated: within one
copy of the item each benchmark value must stand for one value of the document and no two for the same, so a question with other
numbers and names is caught, and a text that only shares its wording's frame is not.

The benchmark is broadcast up to BROADCAST_BYTES of text; beyond that both sides are joined by hash through a shuffle, with the same results.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch, cut, map_rows, mix, small_batches, table

WINDOW = 5
SHARE = 0.8
BROADCAST_BYTES = 16 << 20
#: Characters of documents that are read together.
TOGETHER = 1 << 20
CACHE = 300_000
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Units and number words; fixed values of this method.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent % $ € £ dollar dollars cent cents euro euros".split()
)
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
WORD = regex.compile(r"[\p{L}\p{M}]+|\p{N}+(?:[.,/:]\p{N}+)*|[%$€£]|[.!?:\n]")
ASCII_WORD = re.compile(r"[A-Za-z]+|[0-9]+(?:[.,/:][0-9]+)*|[%$.!?:\n]")
STOPS = frozenset(".!?:\n")
PLAIN, NUMBER, UNITLIKE, STOP = range(4)


def tokens(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def kind_of(w: str, low: str) -> int:
    return STOP if w in STOPS else NUMBER if w[0].isdigit() or low in NUMBERS else UNITLIKE if low in UNITS else PLAIN


def like_name(w: str) -> bool:
    return len(w) > 1 and w[0].isupper() and w[1:].islower()


def template(text: str) -> tuple[list[str], list[str], list[bool]]:
    """(canonical words, the values they stand for, whether a word may be a name too). A capitalised word is a name where no sentence starts, and may be
    one where a sentence does; a unit is one beside a number."""
    words, values, maybe = [], [], []
    fresh, number = True, False
    for w in tokens(text):
        low = w.lower()
        kind = kind_of(w, low)
        if kind == STOP:
            fresh = True
            continue
        c = NUM if kind == NUMBER else UNIT if kind == UNITLIKE and number else low
        number = kind == NUMBER
        name = c == low and like_name(w)
        words.append(NAME if name and not fresh else c)
        values.append(low)
        maybe.append(name and fresh)
        fresh = False
    return words, values, maybe


def window_hashes(ids: np.ndarray, maybe: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, places read as names as bits, hash) for each reading of each window of word hashes; a shorter text has one window, of all its words.

    Each word that may be a name is read as itself and as a name; a word with hash 0 is not known and has no reading as itself. Readings with such a
    name need a word that is no placeholder, or two in windows of fewer than WINDOW words: else a title or "Thanks" would match any names.
    The windows' readings without such a name come first, in order.
    """
    n, k = len(ids) - min(size, len(ids)) + 1, min(size, len(ids))
    ok, readable = np.ones(n if k else 0, bool), (ids != 0) | maybe
    for j in range(k):
        ok &= readable[j : j + len(ok)]
    at = np.flatnonzero(ok)
    named, h = np.zeros(len(at), np.int64), np.full(len(at), k, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        x, other = ids[at + j], maybe[at + j]
        if not other.any():
            h = mix(h + x)
            continue
        own = x != 0
        as_name = (at[other], named[other] | 1 << j, mix(h[other] + NAME_ID))
        at, named, h = (np.concatenate(c) for c in zip((at[own], named[own], mix(h[own] + x[own])), as_name))
    if not named.any():
        return at, named, h
    word = ~np.isin(ids, SLOT_IDS)
    plain = sum(word[at + j] & ((named >> j & 1) == 0) for j in range(k))
    ok = (named == 0) | (plain >= (1 if k == WINDOW else 2))
    return at[ok], named[ok], h[ok]


def word_id(w: str) -> int:
    return xxhash.xxh64_intdigest(w) | 1


NAME_ID = np.uint64(word_id(NAME))
SLOT_IDS = np.array([word_id(w) for w in (NUM, NAME, UNIT)], np.uint64)


class Codes(dict):
    """For each token: its word's place among the known ones (0: not known), whether it looks like a name, and its kind, as one number."""

    def __init__(self, places: dict[str, int]):
        self.places = places

    def __missing__(self, w: str) -> int:
        low = w.lower()
        code = self[w] = self.places.get(low, 0) << 3 | like_name(w) << 2 | kind_of(w, low)
        return code


class Benchmark:
    """Windows of the items, by hash, and the items' words and values."""

    def __init__(self, items: list[tuple]):
        known = {}
        self.items, self.where = {}, defaultdict(list)
        for key, text in items:
            words, values, maybe = template(text or "")
            if not words or key is None:
                continue
            ids = np.array([word_id(w) for w in words], np.uint64)
            known.update(zip(words, map(int, ids)))
            at, named, h = (c.tolist() for c in window_hashes(ids, np.array(maybe, bool)))
            plain = [x for x, bits in zip(h, named) if not bits]  # a window counts once, however it is read
            self.items[key] = (words, values, len({*plain}))
            for q, bits, x in zip(at, named, h):
                self.where[x].append((key, q, bits, plain[q]))
        for c in (NUM, NAME, UNIT):
            known.pop(c, None)
        self.ids = np.array([0, *known.values()], np.uint64)
        self.codes = Codes({w: i for i, w in enumerate(known, 1)})
        self.hashes = np.array(sorted(self.where), np.uint64)
        self.sizes = sorted({WINDOW, *(len(w) for w, _, _ in self.items.values() if len(w) < WINDOW)})

    def read(self, parts: list[list[str]]):
        """Word hashes, 0 if not known, and which words may be names too, of several texts; each text ends with a word of its own that nothing knows."""
        codes, n = self.codes, np.array([len(p) for p in parts])
        if len(codes) > CACHE:
            codes.clear()
        code = np.fromiter(map(codes.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        code = np.insert(code, np.cumsum(n), 0)
        end = np.zeros(len(code), bool)
        end[np.cumsum(n + 1) - 1] = True
        stop = (code & 3) == STOP
        fresh = np.ones(len(code), bool)
        fresh[1:] = (stop | end)[:-1]
        code, fresh, end = code[~stop], fresh[~stop], end[~stop]
        kind, before = code & 3, np.zeros(len(code), bool)
        before[1:] = (kind == NUMBER)[:-1]
        number, unit = kind == NUMBER, (kind == UNITLIKE) & before
        name = (code & 4 > 0) & ~number & ~unit
        ids = self.ids[code >> 3]
        ids[number], ids[unit], ids[name & ~fresh] = SLOT_IDS[0], SLOT_IDS[2], NAME_ID
        return ids, name & fresh, np.flatnonzero(end)

    def match_all(self, texts: list[str]) -> list[list[tuple]]:
        """matches() of each text; several are read at once."""
        out = [[] for _ in texts]
        if not len(self.hashes):
            return out
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= TOGETHER):
                held += len(texts[hi])
                hi += 1
            parts = [tokens(t) for t in texts[lo:hi]]
            ids, maybe, ends = self.read(parts)
            found: dict = defaultdict(list)
            for size in self.sizes:
                if len(ids) < size:
                    continue
                at, _, h = window_hashes(ids, maybe, size)
                if not len(at):
                    continue
                i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[i] == h
                doc = np.searchsorted(ends, at[hit])
                start = np.where(doc > 0, ends[doc - 1] + 1, 0)
                for d, p, x in zip(doc.tolist(), (at[hit] - start).tolist(), h[hit].tolist()):
                    for key, q, bits, own in self.where[x]:
                        found[d, key].append((p, q, own, bits))
            values: dict = {}
            for (d, key), hits in sorted(found.items(), key=lambda x: x[0][0]):
                if d not in values:
                    values = {d: [w.lower() for w in parts[d] if w not in STOPS]}
                if best := self.best(key, hits, values[d]):
                    out[lo + d].append((key, *best))
            lo = hi
        return out

    def matches(self, text: str) -> list[tuple]:
        """(item, share of its windows found with slots that fit, slots bound, first and last word) for each item that text holds at least in part."""
        return self.match_all([text])[0]

    def best(self, key, hits: list, values: list[str]):
        """Over the places where a copy of the item can start, the one with the largest share of windows whose slots fit."""
        words, own, total = self.items[key]
        places: dict[int, list] = defaultdict(list)
        slack = max(2, len(words) // 8)  # words put in or left out move the rest of a copy
        for p, q, x, bits in hits:
            places[(p - q) // slack].append((p, q, x, bits))
        best = None
        for k in places:
            near = sorted(places[k] + places.get(k + 1, []))
            if best and len({x for _, _, x, _ in near}) / total <= best[0]:
                continue
            to: dict[str, Counter] = defaultdict(Counter)
            size = min(WINDOW, len(words))
            slots = [[(NAME if bits >> j & 1 else words[q + j], own[q + j], values[p + j]) for j in range(size) if bits >> j & 1 or words[q + j] in (NUM, NAME, UNIT)] for p, q, _, bits in near]
            for s in slots:
                for kind, a, b in s:
                    to[kind, a][b] += 1
            bound, taken = {}, set()  # the most frequent pairs first; each value of either side once
            for (ka, b), _ in sorted((((ka, b), n) for ka, c in to.items() for b, n in c.items()), key=lambda x: (-x[1], x[0])):
                if ka not in bound and (ka[0], b) not in taken:
                    bound[ka] = b
                    taken.add((ka[0], b))
            fits = {x for (_, _, x, _), s in zip(near, slots) if all(bound.get((kind, a)) == b for kind, a, b in s)}
            share = len(fits) / total
            if best is None or share > best[0]:
                best = (share, len(bound), near[0][0], near[-1][0] + size)
        return best


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", column: str = "text", item: str = "item_id", share: float = SHARE) -> DataFrame:
    """(key, n_items, items, best_share, contaminated) for each row: items are those of which it holds share or more, in order.

    A null or empty text, on either side, matches nothing; an item of fewer than WINDOW words is one window. Null item ids are left
    out; null keys, repeated rows and extra columns are no matter. An empty benchmark leaves every row clean.
    """
    items = _items(benchmark, item)
    known = _small(items)
    if known is None:
        d, best = _by_shuffle(docs.select(key, column), items, key, column, item, share)
        out = d.join(best, "_row", "left").withColumn("items", F.coalesce("items", F.array().cast(best.schema["items"].dataType)))
        return out.select(key, F.size("items").cast("long").alias("n_items"), "items", F.coalesce("best_share", F.lit(0.0)).alias("best_share"), (F.size("items") > 0).alias("contaminated"))
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"{key} {kind}, n_items long, items array<{item_kind}>, best_share double, contaminated boolean"
    arrow = arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches):
        b = Benchmark(pickle.loads(known.value))
        for x in batches:
            found = b.match_all([t or "" for t in x.column(1).to_pylist()])
            hits = [sorted(i for i, s, *_ in m if s >= share) for m in found]
            yield batch(arrow, x.column(0), list(map(len, hits)), hits, [max((s for _, s, *_ in m), default=0.0) for m in found], [bool(h) for h in hits])

    return docs.select(key, column).mapInArrow(run, schema)


def _by_shuffle(docs: DataFrame, items: DataFrame, key: str, column: str, item: str, share: float) -> tuple[DataFrame, DataFrame]:
    """For a benchmark that is too large to broadcast: the rows with a hash of their own, _row, and (_row, items, best_share) of those that match in part.

    A join of window hashes finds (row, item) pairs, whose texts are then compared; short items have windows of their own length, so texts get those too.
    """
    small_batches(docs.sparkSession)
    # 128 bits, so that no two rows of a table meet
    d = docs.withColumn("_row", F.concat(F.hex(F.xxhash64(key, column, F.col(column).isNull())), F.lit("-"), F.hex(F.xxhash64(F.lit(3), F.length(column), column, key))))
    each = cut(_windows(items, item, "text", None).withColumnRenamed(item, "_item"))
    short = [r["n_words"] for r in each.filter(F.col("n_words").between(1, WINDOW - 1)).select("n_words").distinct().collect()]  # WINDOW - 1 lengths at most
    left = _windows(d, "_row", column, [WINDOW, *short]).select("_row", F.explode("hashes").alias("_h"))
    pairs = left.join(each.select("_item", F.explode("hashes").alias("_h")), "_h").select("_row", "_item").distinct()
    both = pairs.join(items.select(F.col(item).alias("_item"), F.col("text").alias("_t")), "_item").join(d.select("_row", F.col(column).alias("_d")).dropDuplicates(["_row"]), "_row")

    def make():
        def row(r, i, d, t):
            m = Benchmark([(i, t)]).matches(d or "")
            return r, i, m[0][1] if m else 0.0

        return row

    scored = map_rows(both, ["_row", "_item", "_d", "_t"], f"_row string, _item {items.schema[item].dataType.simpleString()}, _s double", make)
    return d, scored.groupBy("_row").agg(F.array_sort(F.collect_set(F.when(F.col("_s") >= share, F.col("_item")))).alias("items"), F.max("_s").alias("best_share"))


def _windows(df: DataFrame, key: str, column: str, sizes: list[int] | None) -> DataFrame:
    """(key, hashes, n_words): hashes of windows of these sizes, where the text is long enough; without sizes, of WINDOW words or of all that a shorter text has."""

    def make():
        def row(k, text):
            words, _, maybe = template(text or "")
            ids, maybe = np.array([word_id(w) for w in words], np.uint64), np.array(maybe, bool)
            found = [window_hashes(ids, maybe, n)[2] for n in (sizes or [WINDOW]) if not sizes or n <= len(ids)]
            return k, np.unique(np.concatenate([np.zeros(0, np.uint64), *found])).view(np.int64).tolist(), len(ids)

        return row

    return map_rows(df, [key, column], f"{key} {df.schema[key].dataType.simpleString()}, hashes array<long>, n_words int", make)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", column: str = "text", item: str = "item_id", share: float = SHARE) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    items = _items(benchmark, item)
    known = _small(items)
    if known is None:
        d, best = _by_shuffle(docs, items, key, column, item, share)
        return d.join(best.filter(F.size("items") > 0).select("_row"), "_row", "left_anti").select(*docs.columns)
    small_batches(docs.sparkSession)
    at = docs.columns.index(column)

    def run(batches):
        b = Benchmark(pickle.loads(known.value))
        for x in batches:
            found = b.match_all([t or "" for t in x.column(at).to_pylist()])
            yield x.filter(pa.array([all(s < share for _, s, *_ in m) for m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _items(benchmark: DataFrame, item: str) -> DataFrame:
    return benchmark.select(item, "text").filter(F.col(item).isNotNull())


def _small(items: DataFrame):
    """The items, broadcast, if they hold BROADCAST_BYTES at most, each row counted as 64 bytes besides its text."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    return items.sparkSession.sparkContext.broadcast(pickle.dumps([tuple(r) for r in items.collect()])) if size <= BROADCAST_BYTES else None


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
