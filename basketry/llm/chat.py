"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a table, or of each JSON record, are hashed; the fingerprint picks a declarative mapping that turns the
layout into canonical turns, an array of (role, text) in order. A template then marks the turns, escapes control strings inside
texts so that they can be read back exactly, and says which characters the loss is taken on.

A layout fits where its own paths are all there, by the hash of those of its paths that are; of several the one with most paths counts, so extra
columns are no matter, and tables and records follow one rule. A list's paths are those of all its elements. A system text, wherever a record has one, comes first.
Content in parts is the parts' texts in a row. Null texts and roles count as empty, a null turn number sorts first, equal turn numbers are put in order
of role and text, and repeated rows stay repeated turns. Each row with a null conversation id is a conversation of its own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import table

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Control strings of this template and of common others; fixed values.
CONTROLS = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TURN = "struct<role:string,text:string>"
#: Names that other layouts give the roles; fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts: name -> mapping. A list mapping is (list, role field, text field); a pair mapping is (fields of the user's text, joined by a line end where they are not empty, field of the answer).
LAYOUTS: dict[str, tuple] = {
    "turn_rows": ("rows", "role", "text"),
    "messages": ("messages", "role", "content"),
    "messages_in_data": ("data.messages", "role", "content"),
    "from_value": ("conversations", "from", "value"),
    "role_text": ("turns", "role", "text"),
    "speaker": ("dialog", "speaker", "text"),
    "instruction": (("instruction", "input"), "output"),
    "instruction_plain": (("instruction",), "output"),
    "prompt_input": (("prompt", "input"), "response"),
    "prompt": (("prompt",), "response"),
    "prompt_completion": (("prompt",), "completion"),
    "question_context": (("context", "question"), "answer"),
    "question": (("question",), "answer"),
}


def wants(name: str) -> list[str]:
    """The field paths of a layout."""
    m = LAYOUTS[name]
    return sorted([f"{m[0]}[].{m[1]}", f"{m[0]}[].{m[2]}"] if len(m) == 3 else [*m[0], m[1]])


#: Layouts with most paths first; between equally many, in the order above.
BY_SIZE = sorted(LAYOUTS, key=lambda n: -len(wants(n)))
LISTS = sorted({m[0] for m in LAYOUTS.values() if len(m) == 3} - {"rows"})
FIELDS = sorted({f for m in LAYOUTS.values() if len(m) == 2 for f in (*m[0], m[1])})


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: DataType, at: str = "") -> list[str]:
    if isinstance(kind, StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return field_paths(kind.elementType, f"{at}[]") if isinstance(kind, ArrayType) else [at]


def layout_of(schema: StructType) -> str:
    """The layout that fits a table's nested field paths."""
    paths = {*field_paths(schema)}
    for name in BY_SIZE:
        if fingerprint(paths & {*wants(name)}) == fingerprint(wants(name)):
            return name
    raise ValueError(f"no layout has the fields {sorted(paths)}")


def _pair(role: Column, text: Column) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    role = reduce(lambda c, k: F.when(role == k, ROLES[k]).otherwise(c), ROLES, role)
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text")).cast(TURN)


def _parts(text: Column) -> Column:
    """A text as it is; of content in parts, JSON with a text for each, the texts."""
    parts = F.from_json(text, "array<struct<type:string,text:string>>")
    whole = F.when(text.startswith("[{") & F.exists(parts, lambda p: p["text"].isNotNull()), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    return F.coalesce(whole, text)


def _turns(name: str, get, system: Column | None) -> Column:
    """The turns of a layout. get: a path's column; of a list, an array of maps or structs."""
    m, none = LAYOUTS[name], F.array().cast(f"array<{TURN}>")
    if len(m) == 3:
        said = F.coalesce(F.transform(get(m[0]), lambda x: _pair(x[m[1]], _parts(x[m[2]].cast("string")))), none)
    else:
        ask = F.array_join(F.filter(F.array(*(get(f).cast("string") for f in m[0])), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
        said = F.array(_pair(F.lit("user"), ask), _pair(F.lit("assistant"), get(m[1])))
    return said if system is None else F.concat(F.when(F.coalesce(system, F.lit("")) != "", F.array(_pair(F.lit("system"), system))).otherwise(none), said)


def gather(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, rows) from rows by turn: each conversation's rows in order. A row without a key is a conversation of its own, so they meet in no group."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    some = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return some.unionByName(df.filter(F.col(key).isNull()).select(key, F.array(row).alias("rows")))


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) from a table in any of the layouts, or of rows by turn."""
    if {"turn", "role", "text"} <= {*df.columns}:
        df = gather(df, key)
    return df.select(key, _turns(layout_of(df.schema), F.col, F.col("system").cast("string") if "system" in df.columns else None).alias("turns"))


def canonical_json(df: DataFrame, column: str, key: str = "conv_id") -> DataFrame:
    """(key, layout, turns) from JSON records whose layouts may differ from row to row; an unknown layout, broken JSON and null have a null layout and no turns.

    A list without elements has the layout of its name, with no turns but the system's."""
    c = F.col(column)
    lists = {p: F.from_json(F.get_json_object(c, f"$.{p}"), "array<map<string,string>>") for p in LISTS}
    r = df.select(key, F.json_object_keys(c).alias("_k"), *(x.alias(f"_l_{p}") for p, x in lists.items()), *(F.get_json_object(c, f"$.{f}").alias(f"_f_{f}") for f in (*FIELDS, "system")))
    at = lambda p: F.col(f"`_l_{p}`" if p in LISTS else f"_f_{p}")
    none = F.array().cast("array<string>")
    has = [F.when(F.array_contains("_k", f), F.array(F.lit(f))).otherwise(none) for f in FIELDS]
    for m in LAYOUTS.values():
        if len(m) == 3 and m[0] in LISTS:
            empty = F.size(at(m[0])) == 0
            has += [F.when(empty | F.exists(at(m[0]), lambda x: F.map_contains_key(x, f)), F.array(F.lit(f"{m[0]}[].{f}"))).otherwise(none) for f in m[1:]]
    r = r.withColumn("_paths", F.array_distinct(F.concat(*has)))
    mark = lambda n: F.sha2(F.array_join(F.array_sort(F.array_intersect("_paths", F.array(*map(F.lit, wants(n))))), "\n"), 256) == fingerprint(wants(n))
    names = [n for n in BY_SIZE if n != "turn_rows"]
    r = r.withColumn("layout", F.coalesce(*(F.when(mark(n), F.lit(n)) for n in names)))
    turns = reduce(lambda x, n: F.when(F.col("layout") == n, _turns(n, at, F.col("_f_system"))).otherwise(x), names, F.array().cast(f"array<{TURN}>"))
    return r.select(key, "layout", turns.alias("turns"))


def escape(x: Column) -> Column:
    """Double the backslashes, then put one after the first character of each control string; so no control string is left."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:])), CONTROLS, F.replace(x, F.lit("\\"), F.lit("\\\\")))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def format_chat(df: DataFrame, key: str = "conv_id", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(key, formatted, loss_mask) from (key, turns). loss_mask: for each turn, how many code points it has, and the span of them that the loss is taken on, as start and length; without one the length is 0.

    Spans count from their own turn, so neither writing nor reading a mask walks the text anew for each turn."""
    said = F.transform("turns", lambda m: F.struct(F.concat(F.lit(START), escape(m["role"]), F.lit(SEP)).alias("head"), escape(m["text"]).alias("body"), m["role"].isin(*learn).alias("learn")))
    d = df.select(key, said.alias("_s"))
    text = F.array_join(F.transform("_s", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    span = lambda m: F.struct(
        (F.length(m["head"]) + F.length(m["body"]) + len(END)).alias("size"), F.length(m["head"]).alias("start"), F.when(m["learn"], F.length(m["body"])).otherwise(0).alias("length")
    )
    return d.select(key, text.alias("formatted"), F.transform("_s", span).alias("loss_mask"))


def absolute_mask(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, start, length) for each span of a formatted text that the loss is taken on, in code points from the text's own start; keys must differ."""
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    each = df.select(key, F.posexplode("loss_mask").alias("at", "m"))
    each = each.withColumn("before", F.coalesce(F.sum("m.size").over(w), F.lit(0)))
    return each.filter("m.length > 0").select(key, (F.col("before") + F.col("m.start")).cast("int").alias("start"), F.col("m.length").alias("length"))


def read_back(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns, loss_text, formatted_chars) from what format_chat returned, and from nothing else."""
    parts = F.slice(F.split("formatted", r"<\|end\|>"), 1, F.size("loss_mask"))
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), SEP, 1)).alias("role"), unescape(F.substring_index(p, SEP, -1)).alias("text")
    )
    learnt = F.zip_with(parts, "loss_mask", lambda p, m: F.when(m["length"] > 0, unescape(F.substring(p, m["start"] + 1, m["length"]))).otherwise(F.lit("")))
    return df.select(key, F.transform(parts, turn).alias("turns"), F.array_join(learnt, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(format_chat(canonical_turns(rows)))
    said = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def _sql_escape(x: str) -> str:
    return reduce(lambda c, s: f"replace({c}, '{s}', '{s[0]}' || chr(92) || '{s[1:]}')", CONTROLS, f"replace({x}, chr(92), chr(92) || chr(92))")


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(START + SEP + END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
