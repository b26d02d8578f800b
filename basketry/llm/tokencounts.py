"""Token counts of whole texts, looked up on the map side in two tiers.

Tier one is a broadcast table of the lengths of frequent pre-tokens, of at most TABLE entries. Tier two is a cache in each
Python worker: a pre-token that is in neither is encoded once by the tokenizer, and its length kept until the cache is renewed.
No pre-token is ever shuffled; what a task finds frequent in its part of a sample goes, as one bounded summary, into a tree of merges.
The sample decides only what the first tier holds, never a count.
"""

from __future__ import annotations

import json
import pickle
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import gathered, map_rows, small_batches, table

TABLE = 32_768
SUMMARY = 16_384
CACHE = 400_000
#: Characters of a pre-token that either tier keeps, at most.
LONGEST = 128
RUN = re.compile(r"(?s)(.)\1\1")
FRACTION = 0.02
LIMIT = 1024
#: White space as Unicode's property has it; Python's own adds U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", rf"[{SPACE}]").replace(r"\S", rf"[^{SPACE}]")


#: The same for texts of ASCII characters alone, which Python's own, faster expressions can split.
ASCII_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def load(path: str) -> tuple[Tokenizer, dict[str, int]]:
    """The tokenizer, and its added tokens, which it finds in raw text before anything else."""
    t = Tokenizer.from_file(path)
    return t, {x.content: i for i, x in t.get_added_tokens_decoder().items()}


def splitter(added: dict[str, int]):
    return regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None


def pre_tokens(text: str, pat=regex.compile(PRE_TOKEN)) -> list[str]:
    return (ASCII_TOKEN if text.isascii() else pat).findall(text)


def frequent(docs: DataFrame, column: str = "text", fraction: float = FRACTION) -> list[str]:
    """The pre-tokens that a sampled fraction of the rows holds most often, TABLE at most; an empty table has none."""
    small_batches(docs.sparkSession)

    def summary(batches):
        c = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                c.update(pre_tokens(x or ""))
            if len(c) > 64 * SUMMARY:
                c = Counter(dict(c.most_common(32 * SUMMARY)))
        yield pa.RecordBatch.from_pydict({"s": pa.array([pickle.dumps(c.most_common(SUMMARY))], pa.binary())})

    def merge(a: bytes, b: bytes) -> bytes:
        c = Counter(dict(pickle.loads(a)))
        for k, n in pickle.loads(b):
            c[k] += n
        return pickle.dumps(c.most_common(2 * TABLE))

    parts = docs.select(column).sample(fraction, seed=11).mapInArrow(summary, "s binary").rdd.map(lambda r: bytes(r[0]))
    whole = gathered(parts, merge)
    return [k for k, _ in pickle.loads(whole)[:TABLE]] if whole is not None else []


def ranked(path: str):
    """A merger of single pre-tokens over the same vocabulary, many times faster than the library's calls; None where token ids do not follow the merges' order."""
    with open(path, encoding="utf-8") as f:
        m = json.load(f)["model"]
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    byte = {chr(b if b in shown else next(spare)): b for b in range(256)}
    vocab = m["vocab"]
    made = [vocab.get("".join(x.split(" ") if isinstance(x, str) else x), -1) for x in m["merges"]]
    whole = {*byte} <= {*vocab} and all(a < b for a, b in zip([max(map(vocab.get, byte)), *made], made))
    if not whole or m.get("dropout") or m.get("continuing_subword_prefix") or m.get("end_of_word_suffix"):
        return None
    ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items() if i <= made[-1]}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Lengths:
    """Tokens of each text: pre-tokens are looked up in the first tier, then in the cache, which is renewed when it is full."""

    def __init__(self, path: str, first: dict[str, int]):
        self.tok, self.added = load(path)
        self.split, self.merge = splitter(self.added), ranked(path)
        self.first, self.cache = first, dict(first)

    def size(self, s: str) -> int:
        got = pre_tokens(s)
        found = list(map(self.cache.get, got))
        if None in found:
            new = {w: 0 for w, n in zip(got, found) if n is None}
            self.encode(new)
            known = sum(n for n in found if n is not None)
            known += sum(new[w] for w, n in zip(got, found) if n is None)
            if len(self.cache) + len(new) > CACHE:
                self.cache = dict(self.first)
            self.cache.update((w, n) for w, n in new.items() if len(w) <= LONGEST)
            return known
        return sum(found)

    def encode(self, new: dict[str, int]) -> None:
        """Lengths of pre-tokens that neither tier holds. Where one letter stands three times in a row, pairs overlap, and the library itself is asked."""
        left = []
        for w in new:
            if self.merge is None or RUN.search(w):
                left.append(w)
            else:
                new[w] = len(self.merge(w.encode()))
        if left:
            for w, e in zip(left, self.tok.encode_batch_fast(left, add_special_tokens=False)):
                new[w] = len(e.ids)

    def count(self, text: str) -> int:
        if self.split is not None and any(a in text for a in self.added):
            return sum(1 if p in self.added else self.size(p) for p in self.split.split(text) if p)
        return self.size(text)


_WORKER: list = [None, None]


def lengths(path: str, known) -> Lengths:
    """The tables of a broadcast, made once in each worker and kept for the tasks that it runs later."""
    v = known.value
    if _WORKER[0] is not v:
        _WORKER[:] = [v, Lengths(path, dict(pickle.loads(v)))]
    return _WORKER[1]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text", limit: int = LIMIT, fraction: float = FRACTION) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row, in no order.

    A null text counts as empty; null keys, repeated rows and extra columns are no matter, as rows are read one at a time and only
    two columns are taken. An empty table gives no rows. Added tokens inside a text count one each, as the library has it.
    """
    t, _ = load(path)
    words = frequent(docs, column, fraction)
    sizes = [len(e.ids) for e in t.encode_batch(words, add_special_tokens=False)]
    known = docs.sparkSession.sparkContext.broadcast(pickle.dumps([(w, n) for w, n in zip(words, sizes) if len(w) <= LONGEST]))  # TABLE words of LONGEST characters at most

    def make():
        count = lengths(path, known).count

        def row(k, text):
            text = text or ""
            n = count(text)
            return k, len(text.encode()), n, n > limit

        return row

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, column], f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean", make)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
