"""Secret scans: patterns, and assignment-aware lexing of source and configuration syntax.

The lexer finds assignments (name = value, name: value, name: Type = value, "name": value, name => value, NAME=value, --name=value,
<name>value</name>, <entry key="name">value</entry>, and a name and a value that are given as such) and reads the value as an expression: strings
in any quotes, side by side or joined by operators, over lines where a bracket or an operator goes on, defaults of calls, bare words of
configuration, and comments, which are passed over. It keeps the constants of a text, follows a name that is assigned another name, and scores
each literal by how sensitive the names are that it reaches and by how random it looks. Literals that score SCORE or more are added to what the
patterns find. All positions are code points of the text, the end exclusive. Every step takes time in proportion to the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, sha, small_batches, table

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SCORE = 1.0
#: Weights of the words of a target name; fixed values of this method.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.8, "credentials": 0.8,
    "private": 0.5, "auth": 0.5, "access": 0.3, "key": 0.4, "api": 0.3, "signing": 0.4, "encryption": 0.4, "bearer": 0.7, "client": 0.1, "cookie": 0.3,
}
NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: What may follow a name that is assigned to: a closing quote or bracket, a type, the sign.
TAIL = r"""["'`]?\]?[\x20\t]*+(?::[\x20\t]*+[A-Za-z_](?:[\w.\[\]<>,|?]|[\x20\t](?!=)){0,80}(?:[\x20\t]++=|=(?=[\x20\t]*+["'`]))|:=|=>|<-|[:=])(?![=:/~])"""
PAIR = re.compile(rf"(?:[^A-Za-z_]++|{NAME}(?!{TAIL}))*+(?P<name>{NAME}){TAIL}", re.A)
TOKEN = re.compile(
    r"""(?P<space>[\x20\t]++)|(?P<line>[\r\n]++)|(?P<comment>\#[^\n]*+|//[^\n]*+)|(?P<block>/\*)"""
    r"""|(?P<text>[bBrRuUfF@]{0,2}(?:\"{3}(?s:.)*?\"{3}|'{3}(?s:.)*?'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`))"""
    r"""|(?P<open>[(\[])|(?P<close>[)\]])|(?P<join>\|\||\?\?|\+(?=[\s"'`])|\.\.?(?=[\x20\t]*+["'`])|or\b|,)|(?P<bare>[A-Za-z0-9+/_.=\-]++)""",
    re.A,
)
SIGN = re.compile(r"""[\x20\t]*+(?:=>|:=|[=:])(?![=:/])""")
TAG = re.compile(rf"""<(?P<tag>{NAME})(?:\s[^<>]{{0,200}}?\b(?:key|name|id)=["'](?P<key>{NAME})["'][^<>]{{0,200}})?>\s*+(?P<value>[^<>\s]{{6,}}+)\s*+</(?P=tag)>""", re.A)
ATTRIBUTES = re.compile(rf"""\b(?:key|name)\s?=\s?["'](?P<key>{NAME})["']\s{{1,9}}value\s?=\s?["'](?P<value>[^"'<>\n]++)["']""", re.A)
#: A block comment inside a value, at most.
COMMENT = 2_000
#: A word of more letters holds no assignment of its own.
WORD = 256
MARKS = re.compile(r"[:=>]")
#: Calls whose first literal names a setting; fixed values of this method.
LOOKUPS = ("get", "getenv", "env", "lookup", "fetch", "getproperty", "getstring")


@lru_cache(100_000)
def sensitivity(name: str) -> float:
    words = re.findall(r"[a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower())
    return sum(SENSITIVE.get(w, 0.0) for w in words) + (0.6 if {"api", "key"} <= {*words} else 0.0)


def randomness(s: str) -> float:
    """From 0 to 1: bits a character against six, and whether digits stand among letters."""
    n = len(s)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(s).values())
    return min(1.0, bits / 6 + 0.3 * (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)))


def value(text: str, at: int) -> tuple[list[tuple[int, int]], list[str], int]:
    """The spans of an expression's own literals, without quotes, the names that it uses, and where to read on: behind its sign, or its last word if that is long."""
    own, uses, depth, skips, on = [], [], 0, [], at
    fresh, wanted, n = True, True, len(text)  # fresh: nothing was read yet; wanted: an operand comes next
    while at < n and (m := TOKEN.match(text, at)):
        kind, a, b = m.lastgroup, m.start(), m.end()
        if kind == "block":
            b = text.find("*/", b, b + COMMENT) + 2
            if b < 2:
                break
        elif kind == "line":
            if not depth and (fresh or not wanted):
                break
        elif kind == "text":
            body = m[0].lstrip("bBrRuUfF@")
            q = 3 if len(body) > 5 and body[:3] in ('"""', "'''") else 1
            if skips and skips[-1]:
                skips[-1] = False  # the name of a setting
            else:
                own.append((b - len(body) + q, b - q))
            fresh = wanted = False
        elif kind == "open":
            if not wanted and text[a] == "[":
                break
            depth += 1
            skips.append(False)
            wanted = True
        elif kind == "close":
            if not depth:
                break
            depth -= 1
            skips.pop()
            wanted = False
        elif kind == "join":
            if m[0] == "," and not depth:
                break
            wanted = True
        elif kind == "bare":
            if b - a > WORD:
                on = b
            if not wanted and not depth:
                break
            if SIGN.match(text, b) and m[0][0].isalpha():
                break  # another assignment
            if text[b : b + 1] == "(":
                depth += 1
                skips.append(m[0].rpartition(".")[2].lower() in LOOKUPS)
                b += 1
                wanted = True
            else:
                uses.append(m[0])
                if not depth and fresh:
                    own.append((a, b))
                wanted = False
            fresh = False
        at = b
    return own, uses, on


def assignments(text: str):
    """(place, name, spans of literals, names used) of each assignment, in order of place."""
    out, at = [], 0
    while m := PAIR.match(text, at):  # passes over everything up to the next one
        own, uses, at = value(text, m.end())
        name = m["name"]
        if name.lower() == "value" and out and out[-1][1].lower() in ("key", "name") and out[-1][2] and m.start("name") - out[-1][0] < 400:
            a, b = out[-1][2][0]
            name = text[a:b]
        out.append((m.start("name"), name, own, uses))
    if "</" in text:
        out += [(m.start(), m["key"] or m["tag"], [m.span("value")], []) for m in TAG.finditer(text)]
    if "value" in text:
        out += [(m.start(), m["key"], [m.span("value")], []) for m in ATTRIBUTES.finditer(text)]
    return sorted(out, key=lambda x: x[0])


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name. Work grows with the text, however long a chain of names is: a second pass,
    from the last assignment to the first, hands each one's sensitivity on to those it names."""
    if not MARKS.search(text):
        return []
    latest: dict[str, int] = {}  # name -> its last assignment so far
    literals, named, weights = [], [], []  # of each assignment: its own literals' spans, the assignments it names, all earlier, and its sensitivity
    for _, name, own, uses in assignments(text):
        known = {u for u in uses if u in latest}
        literals.append([(a, b) for a, b in own if b - a >= 6 and text[a:b] not in known])
        named.append([latest[u] for u in known])
        latest[name] = len(weights)
        weights.append(sensitivity(name))
    best: dict[tuple[int, int], float] = {}
    for i in range(len(weights) - 1, -1, -1):
        for j in named[i]:
            weights[j] = max(weights[j], weights[i])
        if weights[i] >= 0.5:
            for a, b in literals[i]:
                score = weights[i] * (0.5 + randomness(text[a:b]))
                if score >= SCORE:
                    best[a, b] = max(score, best.get((a, b), 0.0))
    return [(a, b, x) for (a, b), x in best.items()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if MARKS.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str) -> tuple[list, list]:
    """The patterns' spans, and all spans: the patterns' and the lexer's, in order of start, then kind."""
    base = base_spans(text)
    return base, sorted([*base, *((a, 3, b) for a, b, _ in lexed(text))])


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each span replaced; overlapping spans become one. Of an assignment only the value goes."""
    out, at = [], 0
    values = []
    for a, k, b in spans:
        if k == 0 and (m := ASSIGN.match(text, a)):
            a = m.start(2)
        values.append((a, b))
    for a, b in sorted(values):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_lexed) for each row.

    A null text counts as empty: no spans, and the digest of nothing. Rows are read one at a time, so null keys, repeated rows and
    extra columns are no matter; an empty table gives no rows.
    """

    def make():
        def row(k, text):
            base, spans = scan(text or "")
            n = Counter(kind for _, kind, _ in spans)
            return k, n[0], n[1], n[2], sha(digest(base).encode()), digest(spans), n[3]

        return row

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, column], f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long", make)


def redacted(docs: DataFrame, column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with the secrets in one column replaced; a null text stays null."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(column)

    def run(batches):
        for b in batches:
            texts = [x if not x or not (spans := scan(x)[1]) else redact(x, spans, mark) for x in b.column(at).to_pylist()]
            cols = [*b.columns[:at], pa.array(texts, b.column(at).type), *b.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
