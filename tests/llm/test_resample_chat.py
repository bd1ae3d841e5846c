"""Resampling and chat formatting: brute force, exact round trips and odd rows."""

import hashlib
import math
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowproof.llm import chat_grammar as C
from rowproof.llm import queries as Q
from rowproof.llm import target_resample as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_op11_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    s, t = [0] * 10000, [0] * 10000
    for text in docs.values():
        for w in words(text):
            s[crc32(w.encode()) % 10000] += 1
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        for w in words(r["text"]):
            t[crc32(w.encode()) % 10000] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    want = {}
    for d, text in docs.items():
        weight = sum(gain[crc32(w.encode()) % 10000] for w in words(text))
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        want[d] = [len(words(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    order = sorted((-v[2], d) for d, v in want.items() if v[0] >= 20)
    rank = {d: i for i, (_, d) in enumerate(order[: 10 * len(order) // 100], 1)}
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in Q.op11_target_resample(spark, sf).collect()}
    assert got == {d: [*v, rank.get(d)] for d, v in want.items()}


@pytest.mark.parametrize("spread", [3, 1 << 20, (1 << 63) - 1])
def test_radix_selection_is_exact(spark, spread):
    rng = random.Random(spread)
    rows = [(rng.randint(-spread - 1, spread) if i % 3 else -7 % spread, rng.choice([-(1 << 63), (1 << 63) - 1, 5, i]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5).cache()
    for k in (0, 1, 130, 131, 133, 399, 400, 500):
        got = [tuple(r) for r in df.where(R.smallest(df, [F.col("a"), F.col("b"), F.col("c")], k)).collect()]
        assert sorted(got) == sorted(rows)[:k]


def test_resample_odd_rows(spark):
    text = "alpha beta " * 15
    rows = [(1, text, 9), (1, text, 9), (1, text + "gamma", 9), (None, text, 9), (2, None, 9), (3, "", 9), (4, "Ünï " * 30_000, 9)] + [(i, text, 9) for i in range(10, 45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("rank", F.lit("x")).withColumn("weight", F.lit(1))
    target = spark.createDataFrame([("beta",), (None,)], "text string")
    got = R.resample(docs, target, percent=50).collect()
    assert len(got) == len(rows)
    drawn = sorted((r["rank"], -r["score"], r["id"] is None, r["id"], r["n_features"]) for r in got if r["rank"])
    assert [r[0] for r in drawn] == list(range(1, 21))
    assert [r[1:] for r in drawn] == sorted(r[1:] for r in drawn)
    everything = R.resample(docs, target, percent=100).collect()
    assert sorted(r["rank"] for r in everything if r["rank"]) == list(range(1, 41))
    assert {r["id"] for r in everything if r["rank"] is None} == {2, 3}
    assert R.resample(docs.limit(0), target).collect() == []
    assert len(R.resample(docs, target.limit(0)).collect()) == len(rows)


def test_features_of_several_lengths():
    assert R.text_features("One two  THREE", 2) == (3, [b"one", b"two", b"three", b"one two", b"two three"])
    assert R.text_features(None, 3) == (0, [])
    assert R.text_features("a b É", 1)[1] == ["a b".encode(), "É".encode()]


PIECES = st.sampled_from([*C.MARKS, "[\\INST]", "<\\\\/s>", "\\", "[", "<", "]", ">", " ", "\n", "INST]", "/s>", "ok", "é"])
TEXT = st.lists(PIECES, max_size=8).map("".join)
ROLE = st.one_of(st.sampled_from(["system", "user", "assistant", "tool", ""]), TEXT)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6), st.booleans())
def test_grammar_round_trip(turns, begins):
    rendered, loss, escaped = C.settle(turns, begins)
    assert C.parse(rendered, begins) == turns
    assert [C.unescape(rendered[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    clean = [(r, t) for r, t in turns if not C._ESCAPE.search(r + "\0" + t)]
    assert escaped == len(turns) - len(clean)
    # no mark is left inside a text: all marks are the template's own
    assert len(C._MARK.findall(rendered)) == begins + sum({"assistant": 1, "system": 2, "user": 2}.get(r, 3) for r, _ in turns)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_escape_is_reversible(text):
    assert C.unescape(C.escape(text)) == text


@pytest.mark.parametrize("text", ["", "x", "<s>x", "<s>[INST] a", "<s>[INST] a [/SYS]", "<s>[INST]a[/INST]", "<s> a</s>b", "<s>[/INST]", "<s>[ROLE] a [/ROLE]"])
def test_parser_refuses(text):
    with pytest.raises(C.NotInGrammar):
        C.parse(text)


def test_op12_against_the_source(spark, sf):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        said[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    both = "</s>[INST] ok [/INST]"
    said[-1] = [(0, "user", both), (1, "assistant", both)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {c: (len(t), sha("".join(f"{r}\n{x}\n" for _, r, x in sorted(t))), sum(len(x) for _, r, x in t if r == "assistant"), sha("".join(x for _, r, x in sorted(t) if r == "assistant"))) for c, t in said.items()}
    got = Q.op12_chat_format(spark, sf).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got) and len(got) == len(want)


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, "user", "a"), (None, None, None, None), (2, 0, "tool [TEXT] x", "<s>" * 40_000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").selectExpr("*", "1 AS conv", "'x' AS formatted", "2 AS part")
    out = C.format_chat(df)
    got = {r["conv"]: r for r in C.chat_digest(out).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 3, None: 2, 2: 1}
    assert got[1]["loss_chars"] == 0 and got[1]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    turns = sorted((r["conv"] or 0, r["part"], r["position"], r["role"], r["text"]) for r in C.read_chat(out).collect())
    assert turns == [(0, 0, 0, "", ""), (0, 0, 1, "user", "a"), (1, 0, 0, "user", "hi"), (1, 0, 1, "assistant", ""), (1, 0, 2, "assistant", ""), (2, 0, 0, "tool [TEXT] x", "<s>" * 40_000)]
    assert C.chat_digest(C.format_chat(df.limit(0))).collect() == []


def test_a_long_conversation_comes_in_parts(spark):
    df = spark.range(3000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text </s> ', id) AS text")
    out = C.format_chat(df, part_chars=500).collect()
    assert len(out) > 50 and [r["part"] for r in out] == list(range(len(out)))
    digest = C.chat_digest(C.format_chat(df, part_chars=500)).first()
    whole = C.chat_digest(C.format_chat(df)).first()
    assert digest == whole and digest["n_turns"] == 3000


def test_mixing_keeps_sources_of_empty_texts(spark):
    from rowproof.llm import mixing

    rows = [(i, "some words here " * (i % 5 + 1), "a") for i in range(50)] + [(100 + i, "", "b") for i in range(20)] + [(200 + i, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert {r["id"] for r in got} == {r[0] for r in rows}
    assert sorted(r["id"] for r in got if r["source"] != "a") == [r[0] for r in rows[50:]]  # each once
    empty = mixing.mix_sources(df.where("source is null or source = 'b'")).collect()
    assert len(empty) == 25 and {r["epoch"] for r in empty} == {0}
