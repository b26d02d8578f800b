"""Byte-pair encoding by a streaming transducer with bounded lookahead, and decoding by an incremental state machine.

A token sequence is the encoding of a word exactly when each token encodes to itself and each adjacent pair is stable, that is,
no rule merges across the border between the two while they are built. The transducer takes the longest token that is stable
beside the one before, and turns back where none is; as every prefix has one encoding, a border that failed once never comes back.
How far it can turn back follows from the merge list: a rule can be pre-empted only by an earlier rule that takes its right half,
that one by a still earlier rule, and so on; the longest such chain times the longest token is the sufficient lookahead. Tokens
that lie further back are certain and go out at once, so what is held is bounded by the lookahead, not by the word.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, sha, table
from .tokencounts import SPACE, load, splitter

#: Words in each half of a worker's cache.
CACHE = 500_000
PAIRS = 1_000_000
#: Ids that are decoded at once.
RUN = 8_192
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Characters whose classes are the same in all versions of Unicode at hand: Latin, Greek, Cyrillic, punctuation, kana, Han, Hangul.
COMMON = regex.compile(r"[\0-\u024f\u0370-\u0373\u0384-\u0386\u0388-\u038a\u038e-\u03a1\u03a3-\u03ff\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


BYTES = {c: b for b, c in enumerate(byte_letters())}


class Transducer:
    """Encodes words symbol by symbol; end is the mark that a word's last symbol carries."""

    def __init__(self, vocab: dict[str, int], merges: Iterable, end: str = "</w>"):
        self.vocab, self.end = vocab, end
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.halves: dict[str, tuple[str, str]] = {}
        for a, b in pairs:
            self.halves.setdefault(a + b, (a, b))
        self.longest = max(map(self.width, vocab), default=1)
        chain: dict[str, int] = {}
        deepest = 1
        for a, b in pairs:  # a rule waits on earlier rules whose left half is its right half
            n = 1 + chain.get(b, 0)
            deepest = max(deepest, n)
            if n > chain.get(a, 0):
                chain[a] = n
        self.lookahead = deepest * self.longest
        self.stable: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        made = [t for t in vocab if t not in self.halves or self.is_whole(t)]
        self.inner = {t for t in made if self.width(t) == len(t)}
        self.final = {t[: self.width(t)]: t for t in made if end and t.endswith(end) and t != end} if end else {t: t for t in made}

    def width(self, t: str) -> int:
        return len(t) - (len(self.end) if self.end and t.endswith(self.end) else 0)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges by rank, leftmost first; only called on the symbols of one token, once for each."""
        rank = self.rank
        while len(symbols) > 1:
            r, i = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if r == len(rank):
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        s = list(token[: self.width(token)])
        if len(token) > len(s) and s:
            s[-1] += self.end
        return s

    def is_whole(self, t: str) -> bool:
        if (got := self.whole.get(t)) is None:
            got = self.whole[t] = self.merge(self.symbols(t)) == [t]
        return got

    def edge(self, t: str, side: int) -> list[tuple[str, int, int]]:
        """The pieces at a token's left (0) or right (1) edge while it is built: each with the ranks that make it and take it."""
        if (got := self.edges[side].get(t)) is None:
            got, taken, x = [], len(self.rank), t
            while True:
                made = self.rank[self.halves[x]] if x in self.halves else -1
                got.append((x, made, taken))
                if made < 0:
                    break
                x, taken = self.halves[x][side], made
            self.edges[side][t] = got
        return got

    def is_stable(self, a: str, b: str) -> bool:
        """No rule joins a piece at a's right edge with one at b's left edge while both stand; of equal ranks the left one acts first."""
        if (got := self.stable.get((a, b))) is None:
            if len(self.stable) > PAIRS:
                self.stable.clear()
            rank, got = self.rank.get, True
            for x, made_x, taken_x in self.edge(a, 1):
                for y, made_y, taken_y in self.edge(b, 0):
                    if (m := rank((x, y))) is not None and (at := max(m, made_x, made_y)) < taken_x and at <= taken_y:
                        got = False
            self.stable[a, b] = got
        return got

    def encode_held(self, text: str) -> list[str]:
        """encode() for a word that is no longer than the longest token: nothing can go out before its end."""
        inner, final, stable, n = self.inner, self.final, self.stable, len(text)
        at, upto, last, stack, dead = 0, n, None, [], set()
        while at < n:
            t = final.get(text[at:]) if upto == n else None
            if t is not None and last is not None and not ((ok := stable.get((last, t))) or (ok is None and self.is_stable(last, t))):
                t = None
            if t is not None:
                stack.append(t)
                break
            for to in range(min(upto, n - 1), at, -1):
                if (t := text[at:to]) in inner and to not in dead:
                    if last is None or (ok := stable.get((last, t))) or (ok is None and self.is_stable(last, t)):
                        stack.append(t)
                        at, upto, last = to, n, t
                        break
            else:
                if not stack:
                    raise ValueError(f"no encoding for {text!r}")
                dead.add(at)
                k = len(stack.pop())
                at, upto, last = at - k, at - 1, stack[-1] if stack else None
        return stack

    def encode(self, word: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, each as soon as it is certain. word: its byte letters, in any iterable."""
        vocab, most, stable, whole = self.vocab, self.longest, self.stable, self.whole
        it = iter(word)
        text = "".join(islice(it, 4 * most))  # from the first token that has not gone out
        ended = len(text) < 4 * most
        at, stack, dead = 0, [], set()  # stack: tokens that are not certain yet; dead: borders that failed
        first, upto = True, most  # first: no token has gone out; upto: the longest token to try
        while True:
            if not ended and len(text) - at <= most:
                more = "".join(islice(it, 4 * most))
                ended = len(more) < 4 * most
                text += more
            n = len(text)
            if ended and at == n:
                break
            k = min(upto, n - at)
            last = stack[-1] if stack else None
            while k:
                to = at + k
                t = text[at:] + self.end if ended and to == n else text[at:to]
                if t in vocab and to not in dead and (whole.get(t) or self.is_whole(t)):
                    if last is None:
                        if first:
                            break
                    elif (ok := stable.get((last, t))) or (ok is None and self.is_stable(last, t)):
                        break
                k -= 1
            if k:
                stack.append(t)
                at, upto = at + k, most
                if at > 2 * self.lookahead + most:
                    while at - self.width(stack[0]) > self.lookahead and len(stack) > 1:
                        t = stack.pop(0)
                        k = self.width(t)
                        yield t
                        text, at, first = text[k:], at - k, False
                    dead.clear()  # borders behind; those ahead fail again if they are met
            elif stack:
                dead.add(at)
                k = self.width(stack.pop())
                at, upto = at - k, k - 1
            else:
                raise ValueError(f"no encoding for {text[:40]!r}")
        yield from stack


class Decoder:
    """From ids to text by runs of ids, whatever their borders. marks: keep the vocabulary's own spelling, with a space between tokens, as a
    tokenizer without a decoder does; else bytes are gathered until they make characters, and a word's end becomes a space.

    What is held between runs is whether a token went before, and the bytes of a character that is not complete: at most three."""

    def __init__(self, tokens: list[str], marks: bool = True, end: str = "</w>", added: frozenset = frozenset()):
        self.tokens, self.marks, self.end, self.added = tokens, marks, end, added
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False
        self.raw: dict[int, bytes] = {}

    def spelled(self, i: int) -> bytes:
        """The bytes of a token, with a word's end as a space."""
        t = self.tokens[i]
        over = bool(self.end) and t.endswith(self.end)
        raw = self.raw[i] = bytes(BYTES[c] for c in (t[: -len(self.end)] if over else t)) + b" " * over
        return raw

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these ids make certain."""
        if self.marks:
            text = " ".join(map(self.tokens.__getitem__, ids))
            before, self.started = self.started, self.started or bool(text)
            return " " + text if before and text else text
        out = []
        for i in ids:
            if self.tokens[i] in self.added:
                out += [self.state.decode(b"", True), self.tokens[i]]
            else:
                out.append(self.state.decode(self.raw.get(i) or self.spelled(i)))
        return "".join(out)

    def finish(self) -> str:
        return "" if self.marks else self.state.decode(b"", True)


@lru_cache(4)
def loaded(path: str):
    t, added = load(path)
    with open(path, encoding="utf-8") as f:
        m = json.load(f)["model"]
    coder = Transducer(m["vocab"], m["merges"], m["end_of_word_suffix"] or "")
    names = [""] * (1 + max([*m["vocab"].values(), *added.values()]))
    for k, i in [*m["vocab"].items(), *added.items()]:
        names[i] = k
    return t, added, coder, names


class WordCodec:
    """Encodes whole texts with the word vocabulary; words once seen are kept in a cache of bounded size."""

    def __init__(self, path: str):
        self.tok, self.added, self.coder, self.names = loaded(path)
        self.split, self.pat, self.letters = splitter(self.added), regex.compile(WORD), dict(enumerate(byte_letters()))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, w: str, letters: str) -> bytes:
        """The ids of a word that is not in the newer half of the cache; the older half goes when the newer is full."""
        if (got := self.older.pop(w, None)) is None:
            got = little(array("I", map(self.coder.vocab.__getitem__, self.coder.encode_held(letters) if len(letters) <= self.coder.longest else self.coder.encode(letters))))
        if len(w) <= 64:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[w] = got
        return got

    def ids(self, text: str) -> bytes:
        """The text's ids, as little-endian unsigned 32-bit integers."""
        out = []
        parts = self.split.split(text) if self.split is not None and any(a in text for a in self.added) else [text]
        for p in parts:
            if p in self.added:
                out.append(struct.pack("<I", self.added[p]))
                continue
            if p.isascii():
                words = self.pat.findall(p.lower())
            elif COMMON.fullmatch(p):  # letter by letter: no final sigma
                words = self.pat.findall(unicodedata.normalize("NFC", p).replace("Σ", "σ").lower())
            else:  # rarer scripts: the library's own tables say what is a letter; the words come as byte letters, after a space, which no other word holds
                words = [" " + w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(p))]
            found = list(map(self.cache.get, words))
            if None in found:
                for i, x in enumerate(found):
                    if x is None:
                        w = words[i]
                        found[i] = self.cache.get(w) or self.word(w, w[1:] if w[0] == " " else w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters))
            out += found
        return b"".join(out)

    def decoder(self, marks: bool = True) -> Decoder:
        return Decoder(self.names, marks, self.coder.end, frozenset(self.added))

    def decode(self, ids: Iterable[int], marks: bool = True) -> str:
        d = self.decoder(marks)
        return d.feed(ids) + d.finish()


def little(ids: array) -> bytes:
    if struct.pack("=I", 1) != struct.pack("<I", 1):
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text", texts: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for each row, and with texts also ids, as little-endian unsigned 32-bit integers, and decoded.

    A null text counts as empty: no tokens, and the digests of nothing. Rows are read one at a time, so null keys, repeated rows and
    extra columns are no matter; an empty table gives no rows. Texts and words of any length are encoded whole.
    """

    def make():
        c = WordCodec(path)

        def row(k, text):
            data = c.ids(text or "")
            ids, d, digest, decoded = np.frombuffer(data, "<u4"), c.decoder(), hashlib.sha256(), []
            for lo in range(0, len(ids), RUN):
                part = d.feed(ids[lo : lo + RUN].tolist())
                digest.update(part.encode())
                if texts:
                    decoded.append(part)
            out = k, len(ids), sha(data), digest.hexdigest()
            return (*out, data, "".join(decoded)) if texts else out

        return row

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, column], f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * texts, make)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
