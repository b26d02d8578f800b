"""The operators against brute force, the libraries they must equal, and odd inputs."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import bpe, chat, decontaminate, lmscore, minhash, secrets, suffixes, tokencounts, toxicity, vectors
from basketry.llm.common import components

R = random.Random(4)
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "iota", "zeta"]
LONG = " ".join(R.choice(WORDS) + str(R.randint(0, 99)) for _ in range(3000))
TEXTS = [None, "", "a", "one two", LONG, LONG, LONG + " tail", " ".join(R.choice(WORDS) for _ in range(40)), "é日本 <|endoftext|> x 😀", "x" * 5000, "same text here for all of us", "same text here for all of us"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 0) for i, t in enumerate(TEXTS)] + [(None, LONG, "n", 0), (4, LONG, "n", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, toxic int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
codec, library = bpe.WordCodec(WORD), Tokenizer.from_file(WORD)
lengths, byte_library = tokencounts.Lengths(BYTE, {}), Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
@example("\0")
@example("a \0\0b \u0e01\0")
def test_bpe_equals_the_library(s):
    ids = np.frombuffer(codec.ids(s), "<u4").tolist()
    want = library.encode(s, add_special_tokens=False).ids
    assert ids == want and codec.decode(ids) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("word", ["a" * 9000, "ab" * 4000, "." * 9000, "".join(R.choice("anthei") for _ in range(9000))])
def test_bpe_streams_long_words_in_bounded_memory(word):
    assert np.frombuffer(codec.ids(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    first = next(codec.coder.encode(iter("a" * 100_000)))  # goes out long before the end
    assert first in codec.coder.vocab


def test_bpe_decodes_to_text():
    ids = np.frombuffer(codec.ids("héllo wörld 😀 <|endoftext|>"), "<u4").tolist()
    assert codec.decode(ids, marks=False) == "héllo wörld 😀 <|endoftext|>"


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.lists(st.integers(0, 60), max_size=6))
def test_decoding_does_not_hang_on_the_runs(s, cuts):
    ids = np.frombuffer(codec.ids(s), "<u4").tolist()
    borders = [0, *sorted(min(c, len(ids)) for c in cuts), len(ids)]
    for marks in (True, False):
        d = codec.decoder(marks)
        assert "".join(d.feed(ids[a:b]) for a, b in zip(borders, borders[1:])) + d.finish() == codec.decode(ids, marks)


def test_bpe_rows(docs, empty):
    for r in by_id(bpe.encode_decode(docs, WORD)):
        text = LONG if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(empty, WORD).count() == 0


def test_token_counts(docs, empty):
    t = Tokenizer.from_file(BYTE)
    got = by_id(tokencounts.count_tokens(docs, BYTE, fraction=0.5))
    assert len(got) == docs.count()
    for r in got:
        text = LONG if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
    assert tokencounts.count_tokens(empty, BYTE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("aab .-_\t\n0e"), max_size=60)))
def test_lengths_equal_the_library(s):
    assert lengths.count(s) == len(byte_library.encode(s, add_special_tokens=False).ids)


def test_secrets():
    text = 'x password: "hunter22" AKIA' + "A" * 16 + " " + "0f" * 12 + ' part = "abc123XYZ789"\nauth_secret_key = part + "q9w8e7r6t5"\ncolour = "abcdefabc"'
    base, spans = secrets.scan(text)
    assert [k for _, k, _ in base] == [0, 1, 2] and {*base} <= {*spans}
    found = {text[a:b] for a, k, b in spans if k == 3}
    assert {"abc123XYZ789", "q9w8e7r6t5"} <= found and "abcdefabc" not in found
    assert secrets.base_spans("password: token: abcdefgh") == []  # the failing match takes the second name with it
    clean = secrets.redact(text, spans)
    assert "hunter22" not in clean and "AKIA" not in clean and "colour" in clean
    assert secrets.scan("") == ([], []) and secrets.redact("none", []) == "none"


SECRET = "q9w8e7r6t5"
SOURCES = [
    f'password: str = "{SECRET}"', f'val apiToken: String = "{SECRET}"', f"const secret = `{SECRET}`;", f'auth_secret = os.environ.get("AUTH_SECRET_1") or "{SECRET}"', f'auth_secret = os.environ.get("AUTH_SECRET_1", "{SECRET}")',
    f'api_secret = (\n  "abc123XYZ"\n  "{SECRET}"\n)', f'<entry key="auth_secret">{SECRET}</entry>', f"<password>{SECRET}</password>", f'<add key="ClientSecret" value="{SECRET}"/>', f"- name: AUTH_SECRET\n  value: {SECRET}",
    f'{{"auth_secret": "{SECRET}"}}', f"config['auth_secret'] = '{SECRET}'", f"tool --auth-secret={SECRET} -h x", f'auth_secret = /* old */ "{SECRET}"', f'# auth_secret = "{SECRET}"', f'String authSecret = "{SECRET}";', f'auth_secret := "{SECRET}"',
    f'auth_secret => "{SECRET}",', f'auth_secret = Secret("{SECRET}")', f'auth_secret = """{SECRET}"""', f'base = "{SECRET}"\ncopy = base\nauth_secret = [copy]',
]


@pytest.mark.parametrize("text", SOURCES)
def test_secrets_in_many_syntaxes(text):
    found = {text[a:b] for a, b, _ in secrets.lexed(text)}
    assert SECRET in found and not found & {"String", "AUTH_SECRET_1", "AUTH_SECRET"}


@pytest.mark.parametrize("unit", ["x", "a-", "a = (", 'a="', 'a="\\"', "x = `", "a=/*", "a=b+", '"""a=', "a: b ", "a:", "<a>b", "= ", "token  ", "f" * 23 + " "])
def test_secrets_read_long_texts_in_linear_time(unit):
    short, long = unit * (20_000 // len(unit)), unit * (160_000 // len(unit))
    took = []
    for text in (short, long):
        began = time.process_time()
        secrets.scan(text + " a=1")
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 0.5


def naive(pattern, text, ok):
    """Leftmost matches one after the other, tried at each place on its own."""
    out, at = [], 0
    while at < len(text):
        m = pattern.match(text, at)
        if m and m.end() > at:
            out += [(m.start(), m.end())] * ok(m)
            at = m.end()
        else:
            at += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("tokensecrpasdApI_key:= \"'AKIA0123fe\u212aK\n"), max_size=80), st.sampled_from(["", "token=", "API_KEY : 'abcdef", "AKIA" + "Z9" * 9, "0a" * 13]))
def test_secret_patterns_equal_their_definition(s, more):
    text = s[: len(s) // 2] + more + s[len(s) // 2 :]
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    assign = re.compile(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = [(a, 0, b) for a, b in naive(assign, text, lambda m: len(m[2]) >= 6)]
    want += [(a, 1, b) for a, b in naive(re.compile("AKIA[A-Z0-9]+"), text, lambda m: len(m[0]) >= 20)]
    want += [(a, 2, b) for a, b in naive(re.compile("[0-9a-f]+"), text, lambda m: len(m[0]) >= 24)]
    assert secrets.base_spans(text) == sorted(want)


def test_secrets_follow_long_chains():
    parts = [f"p{i:03}" for i in range(300)]
    lines = [f'{p} = "abc123XYZ{p}"' for p in parts]
    wide = "\n".join([*lines, "password = " + " + ".join(parts)])
    deep = "\n".join([lines[0], *(f'{q} = {p} + "abc123XYZ{q}"' for p, q in zip(parts, parts[1:])), f"password = {parts[-1]}"])
    double = "\n".join([lines[0], *(f"{q} = {p} + {p}" for p, q in zip(parts, parts[1:])), f"password = {parts[-1]}"])
    for text, n in ((wide, 300), (deep, 300), (double, 1), ("\n".join(lines), 0)):
        found = {text[a:b] for a, b, _ in secrets.lexed(text)}
        assert found == {f"abc123XYZ{p}" for p in parts[:n]}


def test_secret_rows(docs, empty):
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in secrets.find_secrets(docs).collect() if r["doc_id"] in (0, 1))
    assert secrets.redacted(docs).count() == docs.count() and secrets.redacted(empty).columns == docs.columns


def test_chat_reads_back_what_it_wrote(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\<|end|>\\", "<|end|", "", None, "\\\\<\\|sep|>\n<|start|>x<|sep|>", "$1 \\1 <s><s>"]
    rows = [(c, i, "assistant" if (i + c) % 2 else "user", t) for c in range(2) for i, t in enumerate(nasty)] + [(None, None, None, None)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    for c in range(2):
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, t or "") for k, _, r, t in rows if k == c]
        assert back[c]["loss_text"] == "".join(t or "" for k, _, r, t in rows if k == c and r == "assistant")
    assert len(back[None]["turns"]) == 1


QA = [("user", "q"), ("assistant", "a")]
RECORDS = [
    ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"id":3}', "messages", QA), ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "from_value", QA),
    ('{"instruction":"q","input":"","output":"a"}', "instruction", QA), ('{"instruction":"q","input":"x","output":"a"}', "instruction", [("user", "q\nx"), ("assistant", "a")]), ('{"instruction":"q","output":"a"}', "instruction_plain", QA),
    ('{"prompt":"q","response":"a","extra":{"x":1}}', "prompt", QA), ('{"prompt":"q","input":"x","response":"a"}', "prompt_input", [("user", "q\nx"), ("assistant", "a")]), ('{"question":"q","answer":"a"}', "question", QA),
    ('{"system":"s","messages":[{"role":"user","content":"q"}]}', "messages", [("system", "s"), ("user", "q")]), ('{"messages":[]}', "messages", []), ('{"messages":[{"content":"q"},{"role":"assistant","content":"a"}]}', "messages", [("", "q"), ("assistant", "a")]),
    ('{"data":{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}}', "messages_in_data", QA), ('{"prompt":"q","response":"a","system":"s"}', "prompt", [("system", "s"), *QA]),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"q"},{"type":"image"},{"type":"text","text":"2"}]}]}', "messages", [("user", "q2")]), ('{"messages":[{"role":"user","content":null}]}', "messages", [("user", "")]),
    ('{"other":1}', None, []), ("{", None, []), (None, None, []), ("[]", None, []), ('{"messages":"x"}', None, []),
]


def test_chat_layouts(spark):
    df = spark.createDataFrame([(i, j, "x") for i, (j, _, _) in enumerate(RECORDS)], "conv_id long, j string, turns string")
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_json(df, "j").collect()}
    assert got == {i: (layout, turns) for i, (_, layout, turns) in enumerate(RECORDS)}


def test_chat_tables_follow_the_rule_of_records(spark):
    for i, (j, layout, turns) in enumerate(RECORDS[:9]):
        df = spark.read.json(spark.sparkContext.parallelize([j])).withColumn("conv_id", F.lit(i))
        assert chat.layout_of(df.schema) == layout
        assert [tuple(t) for t in chat.canonical_turns(df).first()["turns"]] == turns
    with pytest.raises(ValueError):
        chat.layout_of(spark.range(1).schema)


def test_chat_rows(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "assistant", "a"), (1, None, "system", "s"), (1, 1, "user", "b"), (None, 0, "user", "x"), (None, 0, "user", "y"), (2, 0, None, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = sorted(((r["conv_id"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_turns(df).collect()), key=str)
    assert got == sorted([(1, [("system", "s"), ("assistant", "a"), ("user", "b"), ("user", "b")]), (None, [("user", "x")]), (None, [("user", "y")]), (2, [("", "")])], key=str)
    assert chat.read_back(chat.format_chat(chat.canonical_turns(df.filter("false")))).count() == 0


def test_chat_masks(spark):
    long = [(1, i, "assistant" if i % 2 else "user", f"é<s>{i}" * (i % 5)) for i in range(3_000)]
    made = chat.format_chat(chat.canonical_turns(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))).cache()
    back = chat.read_back(made).first()
    assert [t["text"] for t in back["turns"]] == [t for *_, t in long] and back["loss_text"] == "".join(t for _, i, _, t in long if i % 2)
    text, spans = made.first()["formatted"], sorted((r["start"], r["length"]) for r in chat.absolute_mask(made).collect())
    assert re.sub(r"(?s)\\(.)", r"\1", "".join(text[a : a + n] for a, n in spans)) == back["loss_text"]


def test_lm_scores(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = by_id(lmscore.score_texts(docs, path))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    c, n = Counter(), 0
    for k, t in rows:
        if not lmscore.held_out(k):
            words = [*(t or "").encode().lower().split(), None]
            c.update(words)
            n += len(words)
    assert len(got) == len(rows)
    for r in got:
        words = [*((LONG if r["doc_id"] is None else TEXTS[r["doc_id"]]) or "").encode().lower().split(), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + len(c) + 1)) for w in words))
        assert r["score"] < 0 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    assert lmscore.score_texts(empty, path).count() == 0


def test_lm_score_is_the_sum_over_the_lattices(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = lmscore.Vocabulary(path)
    lattice = lmscore.Lattice(v, v.probs)
    for r in lmscore.score_texts(docs, path, steps=0).collect():
        words = ((LONG if r["doc_id"] is None else TEXTS[r["doc_id"]]) or "").encode().lower().split()
        assert r["score"] == pytest.approx((sum(lattice.forward(w.decode()) for w in words) + lattice.end) / np.log(10))


def test_lattices_equal_one_by_one():
    v = lmscore.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    lattice, words = lmscore.Lattice(v, v.probs), ["the", "antion", "internationalisation", "a", "xyzzy", "straße"]
    many = lmscore.Lattices(v, lmscore.Lattices.pack(v, [lmscore.MARK + w for w in words]))
    a, x = many.forward(np.log(v.probs))
    assert a[many.last] == pytest.approx([lattice.forward(w) for w in words])
    want = [0.0] * len(v.probs)
    for i, w in enumerate(words):
        lattice.expected(w, i + 1.0, want)
    assert many.expected(a, x, np.arange(1.0, 7.0), len(v.probs)) == pytest.approx(np.array(want))


def test_em_raises_what_held_out_words_get(spark):
    v = lmscore.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(i, " ".join(R.choice(WORDS) for _ in range(30))) for i in range(60)], "doc_id long, text string")
    built = lmscore.lattices(lmscore.word_counts(docs, "doc_id", "text"), v).cache()
    before, after = (lmscore.step(built, v, p)[1] for p in (v.probs, lmscore.fit(built, v, 50)))
    assert after > before


def test_lattice_sums_all_segmentations():
    v = lmscore.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    lattice = lmscore.Lattice(v, v.probs)

    def total(s):
        out = 1.0 if not s else 0.0
        for i in range(1, len(s) + 1):
            if s[:i] in v.index:
                out += v.probs[v.index[s[:i]]] * total(s[i:])
            elif i == 1:
                out += np.prod([v.probs[len(v.pieces) + b] for b in s[0].encode()]) * total(s[1:])
        return out

    for w in ("the", "antion", "ü", "x\U0001f984y", ""):
        assert lattice.forward(w) == pytest.approx(np.log(total(lmscore.MARK + w)))
    counts = [0.0] * len(v.probs)
    lattice.expected("the", 2.0, counts)
    assert sum(x * len(p) for x, p in zip(counts, v.pieces)) == pytest.approx(2 * 4)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:60] + 0.05 * rng.normal(size=(60, 16)), base[:5], np.zeros((1, 16))]).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [float("nan")] * 16, 0), (902, [None] * 16, 0), (903, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    u = x[:-1] / np.linalg.norm(x[:-1], axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * (near.sum() - len(u)) and len(got) == len(rows)
    assert all(got[i]["n_links"] <= near[i].sum() - 1 for i in range(len(u)))
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (365, 900, 901, 902, 903, None))
    assert vectors.near_vectors(df.filter("false")).count() == 0


def test_embeddings_with_many_lists_and_blocks(spark, monkeypatch):
    for name, x in (("PER_LIST", 4), ("PROBES", 6), ("BLOCK", 16), ("HEAVY", 2)):
        monkeypatch.setattr(vectors, name, x)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 24))
    near = np.concatenate([base[:100] + s * rng.normal(size=(100, 24)) for s in (0.05, 0.1, 0.2)])
    crowd = base[7] + 0.05 * rng.normal(size=(60, 24))
    x = np.concatenate([base, near, crowd, np.repeat(base[9:10], 40, axis=0), 3 * base[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000 + i, v[:5].tolist()) for i, v in enumerate(np.concatenate([base[:20], base[:20]]))]
    rows += [(9500, [1e-200] * 24), (9501, [2e-200] * 24), (9502, [1e200] * 24), (9503, [5e-324] * 24), (9600, [1.0, 0.0]), (9601, [1.0, 0.01]), (7, base[7].tolist())]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    assert len(got) == len(rows)
    by = Counter()
    for r in got:
        by[r["vec_id"]] = r["n_links"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    want[u @ u[7] >= 0.9] += 1  # the second row of 7
    got_links = np.array([by[i] for i in range(len(x))])
    assert (got_links <= want).all() and got_links.sum() >= 0.95 * want.sum()
    assert all(by[9500 + i] == 3 for i in range(4)) and by[9600] == by[9601] == 1
    assert all(by[9000 + i] >= 1 for i in range(40))
    part = {r["vec_id"]: r["component_id"] for r in got}
    assert {part[i] for i in np.flatnonzero(u @ u[7] >= 0.9)} == {min(part[i] for i in np.flatnonzero(u @ u[7] >= 0.9))} and part[9503] == 9500


def test_probes_are_fewer_than_lists():
    rng = np.random.default_rng(1)
    x = vectors.unit(rng.normal(size=(4_000, 32)))
    q = vectors.Quantiser(x, 8)
    cells = q.nearest(x[:50], 10)
    d = ((x[:50, None, :16] - q.coarse[0][None]) ** 2).sum(2)[:, :, None] + ((x[:50, None, 16:] - q.coarse[1][None]) ** 2).sum(2)[:, None, :]
    assert (np.sort(cells, 1) == np.sort(np.argsort(d.reshape(50, -1), axis=1, kind="stable")[:, :10], 1)).mean() > 0.99
    codes, size, rest = q.encode(x, q.nearest(x, 1)[:, 0])
    far = q.asymmetric(q.tables(x[:9]), q.nearest(x, 1)[:, 0], codes, size)
    true = np.sqrt(np.maximum(0, 2 - 2 * x[:9] @ x.T))
    assert (np.sqrt(np.maximum(far, 0)) <= true + rest + 1e-3).all()  # what the codes keep holds every pair


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "changed"
    return " ".join(w)


def test_near_duplicates(spark):
    r = random.Random(6)
    base = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(r.choice([30, 200, 600]))) for _ in range(40)]
    texts = base + [edited(b, 2, i) for i, b in enumerate(base)] + base[:5] + [b.upper() for b in base[:2]] + ["", None, "a b", "a b"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, base[0], 1), (0, base[0], 1)], "doc_id long, text string, class_id int")
    counts, n = minhash.document_frequencies(df, "text")
    s = minhash.Shingler(counts, n)
    sets = [s.weighted(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if minhash.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(texts) + 2 and all(r["class_id"] == root[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert minhash.one_of_each(df).count() == len({*root}) + 1
    assert minhash.near_duplicates(df.filter("false")).count() == 0


def test_similarities_of_many_at_once(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (3, 40, 200, 1, 60)] + ["", "x y z x y z x y z x y z x y"]
    texts += [edited(t, 1, i) for i, t in enumerate(texts[:3])] + [texts[2] + " " + texts[2], texts[1]]
    s = minhash.Shingler(np.zeros(minhash.BUCKETS, np.int32), 5)
    monkeypatch.setattr(minhash, "WIDE", 7)
    sets = [s.weighted(t) for t in texts]
    got = minhash.similarities(s, sets, slice(0, 4), slice(4, len(sets)))
    assert got == pytest.approx(np.array([[minhash.similarity(a, b) for b in sets[4:]] for a in sets[:4]]), abs=1e-5)


def test_near_duplicates_in_mixed_buckets(spark, monkeypatch):
    """Chains of edits in one crowd: buckets hold several classes, and blocks are small."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(16)
    base = [f"w{r.randint(0, 900)}" for _ in range(80)]
    texts = []
    for k in range(60):
        w = list(base)
        for j in range(0, 2 + k % 6):
            w[r.randrange(80)] = f"v{k % 9}{j}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, n = minhash.document_frequencies(df, "text")
    s = minhash.Shingler(counts, n)
    sets = [s.weighted(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if minhash.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(df).collect()}
    assert all(root[got[i]] == root[i] for i in got)  # no link that is none
    assert len({*got.values()}) <= len({*root}) + 2


def test_samples_agree_as_often_as_weights(spark):
    rng = np.random.default_rng(2)
    draw, same, want = minhash.Sampler(), [], []
    for _ in range(60):
        h = np.unique(rng.integers(1, 1 << 62, 60).astype(np.uint64))
        w = rng.uniform(0.5, 3, len(h)).astype(np.float32)
        a, b = (h[:50], w[:50]), (h[10:], w[10:])
        same.append((draw.draw(*a) == draw.draw(*b)).mean())
        want.append(minhash.similarity(a, b))
    assert np.mean(same) == pytest.approx(np.mean(want), abs=0.05)


def test_suffix_array():
    r = random.Random(2)
    for n in (1, 2, 3, 4, 5, 7, 30, 400):
        for k in (1, 2, 200):
            s = np.array([r.randint(1, k) for _ in range(n)])
            assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def brute(rows):
    out, seen = {}, {}
    for k, b in sorted(rows):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.get(b[p : p + 50], k) < k:
                gone[p : p + 50] = b"\1" * 50
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], k)
        out[k] = bytes(x for x, g in zip(b, gone) if not g)
    return out


def test_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)  # in small blocks, so that hot anchors are met
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 500)
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh é") for _ in range(90))
    texts = [None, "", "short", "a" * 300, "a" * 120]
    texts += ["".join(r.choice("abcd") for _ in range(r.randint(0, 200))) + passage[r.randint(0, 30) : r.randint(60, 90)] + "".join(r.choice("abcd") for _ in range(40)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 2) for i, t in enumerate(texts)] + [(None, passage, 2)], "doc_id long, text string, n_spans int").repartition(4)
    got = suffixes.remove_repeats(df, texts=True).collect()
    want = brute([(i, (t or "").encode()) for i, t in enumerate(texts)])
    assert len(got) == len(texts) + 1
    for x in got:
        kept = passage.encode() if x["doc_id"] is None else want[x["doc_id"]]
        assert bytes(x["kept"]) == kept and x["n_removed"] == x["n_bytes"] - len(kept) and x["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffixes.remove_repeats(df.filter("false")).count() == 0
    for few in ("doc_id < 3", "doc_id IS NULL"):  # blocks without an anchor
        assert all(x["n_removed"] == 0 for x in suffixes.remove_repeats(df.filter(few)).collect())


def test_repeats_in_rounds_move_no_block_again(spark, monkeypatch):
    for k, v in {"HOT": 2, "BLOCK_BYTES": 500, "FEW_BYTES": 0, "ROUNDS": 3}.items():
        monkeypatch.setattr(suffixes, k, v)
    r = random.Random(10)
    passage = "".join(r.choice("abcdefgh é") for _ in range(90))
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(0, 200))) + passage[r.randint(0, 30) : r.randint(60, 90)] + "".join(r.choice("abcd") for _ in range(40)) for _ in range(40)]
    out = suffixes.remove_repeats(spark.createDataFrame([*enumerate(texts), (40, texts[7])], "doc_id long, text string").repartition(4), texts=True)
    want = brute([(i, t.encode()) for i, t in enumerate([*texts, texts[7]])])
    assert {x["doc_id"]: bytes(x["kept"]) for x in out.collect()} == want
    lines = out._jdf.queryExecution().sparkPlan().toString(), out._jdf.queryExecution().executedPlan().toString()
    assert "body" in lines[0]
    plan = [x for x in lines[1].split("\n")]
    assert not any("Exchange" in a and "body" in b for a, b in zip(plan, plan[1:]))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    suffixes.cut_dealt(spark.range(9), 3, "id")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_anchors_do_not_hang_on_pieces(monkeypatch):
    r = random.Random(3)
    raw = "".join(r.choice("abcd") for _ in range(5000)).encode()
    ends = np.array([40, 40, 900, 901, 3000, 5000])
    whole = suffixes.anchors(np.frombuffer(raw, np.uint8), ends)
    for piece in (50, 64, 999):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        assert suffixes.anchors(np.frombuffer(raw, np.uint8), ends).tolist() == whole.tolist()


def test_repeats_of_whole_documents(spark):
    r = random.Random(5)
    a, b = ("".join(r.choice(of) for _ in range(n)) for of, n in (("abcdé ", 400), ("abcd", 49)))
    texts = [(5, a), (3, a), (9, a), (4, b), (6, b), (3, a), (7, a + "tail" * 20), (1, "x" * 60), (2, "x" * 60), (None, a), (8, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeats(df).collect())
    size = len(a.encode())
    want = [(-1, size, 0, 0), (1, 60, 0, 0), (2, 60, 60, 1), (3, size, 0, 0), (3, size, 0, 0), (4, len(b.encode()), 0, 0), (5, size, size, 1), (6, len(b.encode()), 0, 0), (7, size + 80, size, 1), (-1, 0, 0, 0), (9, size, size, 1)]
    assert got == sorted((k if k != -1 or n else 8, n, x, y) for k, n, x, y in want)


ITEM = "In the garden Mary has 5 apples and 7 pears, and she gives Peter 5 apples for 3 dollars; how many pears are left with Mary then?"


@pytest.mark.parametrize(
    "text, bad",
    [
        (f"Before it. {ITEM} After it.", True), (ITEM.replace("Mary", "Anna").replace("5", "8").replace("7", "11"), True), (ITEM.replace("5 apples and", "8 apples and"), False), ("nothing of the kind at all in here", False), ("", False), (None, False),
        ("In the garden Mary has 5 apples and nothing else", False),
    ],
)
def test_decontamination(text, bad):
    share = max((s for _, s, *_ in decontaminate.Benchmark([(1, ITEM), (2, None), (3, "")]).matches(text or "")), default=0)
    assert (share >= decontaminate.SHARE) == bad


STARTS = "{0} picks {2} apples in the garden every day. {0} then sells {3} of them for {4} dollars at the market. {1} buys the rest. How many apples does {1} buy from {0} in a week?"
ONLY_STARTS = "{0} picks {2} apples in the garden every day and eats one. {1} sells {3} of them for {4} dollars at the market. {0} buys the rest of them. How many are left?"


@pytest.mark.parametrize("item", [STARTS, ONLY_STARTS])
def test_names_that_start_sentences(item):
    b = decontaminate.Benchmark([(1, item.format("Mary", "Peter", 5, 3, 2))])
    share = lambda text: max((s for _, s, *_ in b.matches(text)), default=0)
    assert share(item.format("Anna", "Boris", 9, 4, 7)) == share(item.format("Mary", "Peter", 5, 3, 2)) == 1
    assert share("and then, " + item.format("Anna", "Boris", 9, 4, 7)) == 1
    assert share(item.format("Anna", "Anna", 9, 4, 7)) < 1  # one name cannot stand for two


def test_short_items_are_not_read_as_names_alone():
    b = decontaminate.Benchmark([(1, "Yes"), (2, "Thank you"), (3, "Apples\nPears\nPlums\nFigs\nDates")])
    assert not b.matches("So then Mary met Peter. Anna\nBoris\nCarla\nDora\nEmil. Mary you know.")
    assert {k for k, s, *_ in b.matches("they said yes. Thank you") if s == 1} == {1, 2}


def test_decontamination_rows(spark, docs, empty, monkeypatch):
    b = spark.createDataFrame([(1, TEXTS[10] + " and of them"), (2, None), (None, LONG)], "item_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.contaminated(docs, b, share=0.4).collect()}
    assert [k for k, v in got.items() if v] in ([10, 11], [11, 10])
    assert decontaminate.contaminated(docs, b.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.contaminated(empty, b).count() == 0
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    far = {r["doc_id"]: r["contaminated"] for r in decontaminate.contaminated(docs, b, share=0.4).collect()}
    assert far == got


def test_decontamination_is_the_same_by_shuffle(spark, monkeypatch):
    whole = "alpha beta gamma delta omega sigma kappa theta iota zeta alpha gamma"
    rows = [(0, f"x y {whole} z"), (1, " ".join(whole.split()[:8])), (2, "it is one small step then"), (3, "one small"), (4, None), (5, ""), (6, "nothing of the kind at all"), (None, whole), (None, "clean words only in here"), (7, "small step"), (7, "no words alike"), (8, "solo")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, whole), (2, "small step"), (3, "solo"), (4, "is one small step"), (5, None), (6, ""), (None, whole), (7, "alpha beta gamma delta omega and more of it"), (1, whole)]
    b = spark.createDataFrame(items, "item_id long, text string")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    near, kept = order(decontaminate.contaminated(d, b)), order(decontaminate.clean(d, b))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert order(decontaminate.contaminated(d, b)) == near and order(decontaminate.clean(d, b)) == kept
    by = {k: (items, best) for k, _, items, best, _ in near if k is not None and k != 7}
    assert by[2][0] == [2, 4] and by[8][0] == [3] and by[1][0] == [] and 0 < by[1][1] < decontaminate.SHARE and by[6] == ([], 0.0)
    assert {r[0] for r in kept} == {1, 3, 4, 5, 6, 7, None} and len(kept) == 7


def naive_matches(items, text):
    """Benchmark.matches by words: windows are tuples, tried one by one."""

    def readings(words, maybe, size):
        k = min(size, len(words))
        for p in range(len(words) - k + 1) if k else ():
            free = [j for j in range(k) if maybe[p + j]]
            for n in range(1 << len(free)):
                bits = sum(1 << j for i, j in enumerate(free) if n >> i & 1)
                w = tuple(decontaminate.NAME if bits >> j & 1 else words[p + j] for j in range(k))
                plain = sum(x not in (decontaminate.NUM, decontaminate.NAME, decontaminate.UNIT) for x in w)
                if not bits or plain >= (1 if k == decontaminate.WINDOW else 2):
                    yield p, bits, w

    b, out = decontaminate.Benchmark(items), {}
    words, values, maybe = decontaminate.template(text)
    for key, item in items:
        own, _, may = decontaminate.template(item)
        size, hits = min(len(own), decontaminate.WINDOW), []
        plain = {q: w for q, bits, w in readings(own, may, size) if not bits}
        for q, bits, w in readings(own, may, size):
            hits += [(p, q, hash(plain[q]), bits) for p, _, x in readings(words, maybe, size) if x == w and len(words) >= size]
        if hits and (best := b.best(key, hits, values)):
            out[key] = best[0]
    return out


PIECES = st.sampled_from(["Mary", "Peter", "Anna", "has", "5", "7", "apples", "km", "dollars", ".", "the", "The", "in", "garden", "and", "unknown", "\n", "three", "é"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, min_size=1, max_size=14), min_size=1, max_size=3), st.lists(st.lists(PIECES, max_size=25), min_size=1, max_size=4), st.integers(0, 2))
def test_matches_equal_brute_force(items, texts, at):
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    texts = [" ".join(w) for w in texts] + [" ".join(texts[0]) + " " + items[min(at, len(items) - 1)][1].replace("Mary", "Boris").replace("5", "8"), ""]
    got = decontaminate.Benchmark(items).match_all(texts)
    for text, found in zip(texts, got):
        assert {k: s for k, s, *_ in found} == pytest.approx(naive_matches(items, text))


def test_both_ways_of_matching_agree_on_random_texts(spark, monkeypatch):
    r = random.Random(12)
    words = ["Mary", "Peter", "has", "5", "7", "apples", "km", ".", "the", "The", "garden", "and", "three"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, line(r.choice([1, 2, 3, 4, 5, 6, 12, 20]))) for i in range(25)]
    texts = [(i, line(r.randint(0, 40)) + (" " + r.choice(items)[1] if i % 2 else "")) for i in range(60)] + [(3, "again"), (3, "again"), (None, items[0][1])]
    d, b = spark.createDataFrame(texts, "doc_id long, text string").withColumn("items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    for share in (0.3, 0.8):
        order = lambda df: sorted(map(tuple, df.collect()), key=str)
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 1 << 20)
        near = order(decontaminate.contaminated(d, b, share=share))
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
        assert order(decontaminate.contaminated(d, b, share=share)) == near and len(near) == len(texts)


def test_toxicity_fit_takes_one_row_of_a_key(spark):
    docs = spark.createDataFrame([(i % 20, f"word{i % 7} alpha beta", "x") for i in range(400)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i % 20, 1, int(i == 3)) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (toxicity.fit_chain(d, labels, toxicity.CATEGORIES) for d in (docs, docs.orderBy(F.desc("text"))))
    assert all((x == y).all() for x, y in zip(a.weights, b.weights))


def test_toxicity_fit_brings_only_chosen_features_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join([*("".join(rng.choice([*"abcdefghij"], 9)) for _ in range(400)), "good" if i % 2 else "bad", "poor" if i % 3 else "rich"]) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    met, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: met.append(got := collect(df)) or got)
    chain = toxicity.fit_chain(docs, labels, toxicity.CATEGORIES)
    assert sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 for rows in met for r in rows for v in r) < 60 * 200  # all features: 60 * 1,600 * 8
    has = [{h for w in toxicity.read(t)[0] for h in toxicity.features(w)} for t in texts]
    want = []
    for h in set().union(*has):
        df = sum(h in x for x in has)
        pos = [np.array([sum(h in x for x, i in zip(has, range(60)) if i % 3)]), np.array([sum(h in x for x, i in zip(has, range(60)) if i % 2)])]
        want += [h] * bool(df >= 3 and toxicity.differences(np.array([df]), pos, 60, [40, 30])[0] > 5)
    assert chain.chosen.tolist() == sorted(want) and len(want) >= 2
    assert [toxicity.scorer(chain)(t)[1] >= 0.5 for t in texts] == [i % 2 == 1 for i in range(60)]


def test_toxicity(spark):
    r = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = [r.choice(WORDS) + r.choice(["", "s", "ing"]) for _ in range(60)] + (["blargh" + r.choice(["", "ed", "ing"])] if bad else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), "x"))
        marks.append((i, int(i % 3 > 0), int(bad)))
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "alpha", "x"), (902, "12345 !!", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([*marks, *marks[:3], (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels.filter("doc_id < 300"), toxicity.CATEGORIES)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(docs, chain, list(toxicity.CATEGORIES)).collect()}
    assert sum(got[i] == (i % 5 == 0) for i in range(300, 400)) >= 99 and not (got[900] or got[901] or got[902])
    assert toxicity.without_toxic(docs, chain).count() == sum(not v for v in got.values())
    assert toxicity.fit_chain(docs, labels.filter("toxic = 0"), toxicity.CATEGORIES) is None
    assert toxicity.score_toxicity(docs, None, list(toxicity.CATEGORIES)).filter("toxic").count() == 0
    assert toxicity.without_toxic(docs.filter("false"), chain).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_shuffled_paths(spark):
    ids = random.Random(8).sample(range(10_000), 3_000)
    links = [*zip(ids[:2_000], ids[1:2_000]), *zip(ids[2_000:], ids[2_001:])]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids[:2_000], min(ids[:2_000])), **dict.fromkeys(ids[2_000:], min(ids[2_000:]))}


def test_components_of_stars_and_grids(spark):
    star = [(5_000, i) for i in range(400)]
    at = random.Random(9).sample(range(10_000, 20_000), 400)
    grid = [(at[20 * i + j], at[20 * i + j + 1]) for i in range(20) for j in range(19)] + [(at[20 * i + j], at[20 * i + 20 + j]) for i in range(19) for j in range(20)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(star + grid, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(400), 5_000], 0), **dict.fromkeys(at, min(at))}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0, name


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Toxic words, copies, a benchmark question with other names and numbers, and secrets are planted; what is left is worked out without Spark."""
    import corpus_pipeline as P

    r = random.Random(21)
    plain = [" ".join(f"w{r.randint(0, 9000)}" for _ in range(60)) for _ in range(200)]
    bad = [" ".join([f"w{r.randint(0, 9000)}" for _ in range(50)] + ["blargh", "blarghing"]) for _ in range(50)]
    near = [edited(t, 1, i) for i, t in enumerate(plain[:20])]
    leaks = [f"{plain[50 + i]} more {ITEM.replace('Mary', n).replace('5', str(20 + i))} end{i}" for i, n in enumerate(["Anna", "Boris", "Clara"])]
    secret = [f'{" ".join(f"s{r.randint(0, 9000)}" for _ in range(30))} password = "hunter2Xy9zQ{i}" tail' for i in range(5)]
    texts = plain + bad + near + plain[:6] + leaks + secret + ["", None]
    ids = r.sample(range(10_000), len(texts))
    toxic = {*ids[200:250]}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)] + [(None, "no key but words", "en", "s", 16), (ids[3], texts[3], "en", "s", len(texts[3]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in ids[:250]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {i: t for i, t in zip(ids, texts) if i not in toxic}
    sets = {i: Counter(zip(*(re.findall(r"\w+", (t or "").lower())[k:] for k in range(5)))) for i, t in left.items()}
    df = Counter(x for s in sets.values() for x in s) + Counter([("no", "key", "but", "words")])
    n = len(left) + 2
    df.update({**dict.fromkeys(sets[ids[3]], 1)})  # the repeated row
    weight = {x: 1 - np.log(max(k / n, 1 / 256)) / np.log(256) for x, k in df.items()}
    root = {i: i for i in left}
    for i in left:
        for j in left:
            if i < j and sets[i] and sets[j]:
                low = sum(min(k, sets[j][x]) * weight[x] for x, k in sets[i].items())
                high = sum(max(sets[i][x], sets[j][x]) * weight[x] for x in {*sets[i], *sets[j]})
                if low / high >= 0.8:
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if v == b else v for k, v in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i and "she gives Peter" not in (t or "")}
    want = [(i, library.encode(re.sub(r"hunter2Xy9zQ\d", "[SECRET]", t or ""), add_special_tokens=False).ids) for i, t in left.items()] + [(None, library.encode("no key but words").ids)]
    got = [(x["doc_id"], np.frombuffer(x["ids"], "<u4").tolist()) for x in P.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(got) == 200 + 5 + 2 + 1 and sum(i in {*ids[250:276]} for i, _ in got) + sum(i in {*ids[:20]} for i, _ in got) == 20
