"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowproof.llm import decontam, exact_dedup, html_blocks, license_scan, mixing, pii_crf, quality_zstd, simhash_bk, toxicity_fm, url_reputation

LONG = "word " * 60_000
ROWS = [(1, "Alpha beta  gamma delta", "a"), (2, "Alpha beta\ngamma delta", None), (2, "Alpha beta\ngamma delta", None), (3, None, "a"), (4, "", "b"), (None, "Alpha beta gamma delta", "b"), (5, LONG, "a"), (6, " ", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    # clashing names: columns that the operators use themselves
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.selectExpr("doc_id", "text", "source", "'x' AS score", "1 AS len", "'y' AS host", "2 AS sha", "3 AS node", "'z' AS base", "4 AS tokens", "5 AS id")


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs, digest=True).collect()
    assert len(got) == len(ROWS)
    alpha = [r for r in got if r["group_size"] == 4]
    assert len(alpha) == 4 and {r["keep_id"] for r in alpha} == {1} and sum(r["kept"] for r in alpha) == 1
    empty = [r for r in got if r["group_size"] == 2]
    assert {r["id"] for r in empty} == {3, 4} and {r["keep_id"] for r in empty} == {3}
    kept = exact_dedup.keep_first(docs.select("doc_id", "text", "source"))
    assert sorted((r["doc_id"] for r in kept.collect())) == [1, 3, 5, 6]
    assert exact_dedup.exact_dedup(docs.limit(0)).collect() == []


def test_keep_first_keeps_one_of_repeated_winners(spark):
    df = spark.createDataFrame([(7, "same"), (7, "same"), (8, "same")], "doc_id long, text string")
    assert [tuple(r) for r in exact_dedup.keep_first(df).collect()] == [(7, "same")]


def test_simhash(docs):
    got = simhash_bk.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {(r["id"], r["fp0"]): r["component"] for r in got}
    assert {c for (i, fp), c in by.items() if fp == 0} == {3}
    assert simhash_bk.near_duplicates(docs.limit(0)).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 8))
def test_tree_links_span_all_links(base, radius):
    members = sorted({x ^ (1 << k) ^ (1 << (k * 7 % 64)) for x in base for k in range(4)} | set(base))
    parent = {m: m for m in members}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in simhash_bk.tree_links(members, radius):
        assert (a ^ b).bit_count() <= radius
        parent[find(parent, a)] = find(parent, b)
    brute = {m: m for m in members}
    for i, a in enumerate(members):
        for b in members[:i]:
            if (a ^ b).bit_count() <= radius:
                brute[find(brute, a)] = find(brute, b)
    pairs = [(a, b) for a in members for b in members]
    assert all((find(parent, a) == find(parent, b)) == (find(brute, a) == find(brute, b)) for a, b in pairs)


def test_large_shards_are_split_without_loss(spark):
    """One ball of near fingerprints, with shards limited to forty members: every link of brute force stays."""
    import random

    rng = random.Random(2)
    ball = sorted({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) ^ 0x5555 for _ in range(150)})
    df = spark.createDataFrame([(simhash_bk._signed(x),) for x in ball], "fp long")
    got = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash_bk.links(df, 4, 6, 2, most=40).collect()]
    parent = {x: x for x in ball}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in got:
        assert (a ^ b).bit_count() <= 4
        parent[find(parent, a)] = find(parent, b)
    brute = {x: x for x in ball}
    for i, a in enumerate(ball):
        for b in ball[:i]:
            if (a ^ b).bit_count() <= 4:
                brute[find(brute, a)] = find(brute, b)
    assert all((find(parent, a) == find(parent, b)) == (find(brute, a) == find(brute, b)) for a in ball for b in ball)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (100, 105)]
    got = {r["node"]: r["root"] for r in simhash_bk.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}
    assert got == want


def test_license_scan(docs, spark):
    got = license_scan.license_digest(license_scan.license_scan(docs)).collect()
    assert sorted(r["n_words"] for r in got) == [0, 0, 0, 4, 4, 4, 4, 60_000]
    df = spark.createDataFrame([(1, "CC BY-SA 4.0, cc by cc-by; MIT License. SPDX-License-Identifier: Apache-2.0"), (2, "xcc by mitlicense")], "doc_id long, text string")
    one, two = license_scan.license_digest(license_scan.license_scan(df)).orderBy("doc_id").collect()
    assert (one["n_base"], one["first_word"], one["last_word"], one["base_labels"]) == (4, 0, 9, "cc-by,mit")
    assert one["labels"] == "apache-2.0,cc-by,cc-by-sa,mit" and one["score"] == 1.0
    assert (two["n_base"], two["labels"]) == (0, "")
    assert license_scan.license_scan(docs.limit(0)).collect() == []


def test_url_filter(spark):
    urls = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/7?x#y"), (4, "https://bad.example.co.uk/a"), (4, "https://bad.example.co.uk/a"), (5, "x://h?q"), (6, "")]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS n", "3 AS rule")
    outcomes = spark.createDataFrame([(f"https://bad.example.co.uk/{i}", 1) for i in range(60)] + [(f"https://good.example.com/{i}", 0) for i in range(60)], "url string, bad int")
    rules = [("block", "com/en/"), ("allow", "example.com/en/7")]
    got = {r["page_id"]: r for r in url_reputation.url_filter(pages, outcomes, rules, keep=("page_id",)).collect()}
    assert (got[1]["host"], got[2]["path"], got[6]["host"]) == ("", "", "")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[4]["verdict"] == "block" and got[4]["rule"] is None and got[5]["host"] == "h"
    assert len(url_reputation.url_filter(pages, outcomes.limit(0), rules, keep=("page_id",)).collect()) == 7
    assert url_reputation.url_filter(pages.limit(0), outcomes.limit(0), rules, keep=("page_id",)).collect() == []


def test_html():
    tree = html_blocks.grow_tree(list(html_blocks.LABELLED))
    page = """<html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav>
    <div class="cookie-notice">We use cookies, a great many of them, on every page of this site for all kinds of reasons.</div>
    <main><article><header><h1>Head&amp;line</h1></header><p>One  two<br>three</p><p>Be.<p>More <a href=x>linked</a> text here
    <aside>Sidebar text</aside><form><label>Mail</label><input></form><script>if (a < b) { document.write("<p>no</p>"); }</script>
    <section id="comments"><p>I really liked this long article about everything, thanks so much for writing it all down.</p></section></article></main>
    <div class='ad banner'>Buy now</div><footer>&copy; me</footer></body>"""
    assert html_blocks.main_text(page, tree) == "Head&line\n\nOne two three\n\nBe.\n\nMore linked text here"
    assert html_blocks.main_text(None, tree) == "" and html_blocks.main_text("<p", tree) == "" and html_blocks.main_text("<!-- open", tree) == ""
    plain = "<p>" + "This is a paragraph of a page without any article element in it at all, with plenty of words. " * 2 + "</p>"
    assert html_blocks.main_text(f"<ul><li><a>Menu</a></li></ul>{plain}{plain}", tree).count("paragraph") == 4


def test_html_frame(spark):
    df = spark.createDataFrame([(None, "u", None), (1, None, "<article><p>Hi</p></article>")], "page_id long, url string, html string").selectExpr("*", "'t' AS text")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_blocks.extract_main_text(df).collect()) == [(0, "", 0), (1, "Hi", 2)]


def test_classifiers_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_zstd.train_quality(docs, none)
    assert {round(r["score"], 6) for r in quality_zstd.score_quality(docs, model).collect()} == {0.5}
    machine = toxicity_fm.train_toxicity(docs, none)
    assert {round(r["score"], 6) for r in toxicity_fm.score_toxicity(docs, machine).collect()} == {0.5}
    one = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(toxicity_fm.score_toxicity(docs, toxicity_fm.train_toxicity(docs, one)).collect()) == len(ROWS)


def test_machine_learns_pairs():
    """Neither word alone is toxic, both together are: no sum of single weights can say so."""
    sample = [(int(a and b), " ".join(w for w, on in (("alpha", a), ("omega", b)) if on) + f" filler{i % 5}") for i in range(400) for a, b in [(i % 2, i // 2 % 2)]]
    fm = toxicity_fm.fit_machine(sample)
    both, a, b, neither = fm.scores(["alpha omega", "alpha", "omega", None])
    assert both > 0.7 > 0.5 > max(a, b, neither)


def test_compression_model_separates():
    """Prose against symbols, shouting and repetition, on texts that the fit has not seen."""
    import random

    rng = random.Random(1)
    syllables = ["ta", "ren", "mo", "lis", "ve", "der", "an", "ko", "str", "ing"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(800)]
    prose = lambda: [rng.choice(words) for _ in range(rng.randint(20, 300))]
    noise = [lambda ws: [w + rng.choice(["%%%", "***", "$$$"]) for w in ws], lambda ws: [w.upper() + "!!" for w in ws], lambda ws: [w for w in ws[:10] for _ in range(12)]]

    def sample(n):
        return [(1, " ".join(prose())) for _ in range(n)] + [(0, " ".join(noise[i % 3](prose()))) for i in range(n)]

    m = quality_zstd.fit_quality(sample(200))
    test = sample(60)
    right = sum((s >= 0.5) == bool(y) for s, (y, _) in zip(m.scores([t for _, t in test]), test))
    assert right >= 0.95 * len(test)
    assert 0 < m.scores([None])[0] < 1


def test_decontamination(docs, spark):
    item = "the quick brown fox jumps over the lazy dog while seven bright birds watch from a tall old tree"
    edited = item.replace("lazy", "sleepy").replace("bright ", "").replace("old", "ancient")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    extra = spark.createDataFrame([(10, f"intro text {item.upper()} outro"), (11, f"some {edited} more"), (12, "the dog and the tree and the fox"), (13, "here are two words")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra).selectExpr("*", "1 AS leaks", "2 AS found")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.decontaminate(both, bench).collect()}
    assert got[10] == [1, 1] and got[11] == [1, 1] and got[12] == [] and got[13] == [4] and got[5] == []
    assert len(decontam.decontaminate(docs, bench.limit(0)).collect()) == len(ROWS)
    assert decontam.decontaminate(docs.limit(0), bench).collect() == []


def test_mixing(docs):
    got = mixing.mix_sources(docs, budget=200_000).collect()
    assert {r["source"] for r in got} == {"", "a", "b", "c"}
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_skip_chain_spreads_labels():
    sample = [f"Call +1 (853) 555-{i:04d} or mail user{i}@mail.example.com from 10.0.{i}.7 with 4111111111111111" for i in range(200)]
    field = pii_crf.fit_field(sample)
    text = "Please call +1-853-555-7168 today. " + "Filler words without digits. " * 20 + "Once more: 1-853-555-7168."
    base, added = pii_crf.all_spans(text, field)
    assert [text[a:b] for _, a, b in base] == ["+1-853-555-7168"]
    assert [(pii_crf.KINDS[k], text[a:b]) for k, a, b in added] == [("phone", "1-853-555-7168")]
    assert pii_crf.all_spans(None, field) == ([], []) and pii_crf.all_spans("", field) == ([], [])
    assert pii_crf.redact(text, base + added).count("[phone]") == 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a1@.+-( )9%é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    from test_contracts import base_spans

    got = [(pii_crf.KINDS[k], a, b) for k, a, b in pii_crf.base_spans(text)]
    assert got == base_spans(text)


def test_base_spans_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 100_000, "+1 " * 60_000, "1.1." * 50_000, "1-" * 100_000):
        pii_crf.base_spans(text)


def test_personal_data(docs):
    field = pii_crf.train_field(docs)
    got = pii_crf.find_personal_data(docs, field).collect()
    assert len(got) == len(ROWS) and all(r["base"] == [] for r in got)
    assert pii_crf.find_personal_data(docs.limit(0), field).collect() == []


def test_pipeline_stages_on_odd_rows(docs, spark, sf):
    """Clashing columns, nulls, repeats and a very long text go through every stage; empty tables stay empty."""
    import corpus_pipeline

    odd = docs.withColumnRenamed("id", "leaks").selectExpr("doc_id", "text", "source AS lang", "source", "5 AS n_chars", "score", "len", "sha", "node", "base", "tokens", "leaks")
    for rows in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, sf)
            n = out.count()
            assert k == 4 or (n <= len(ROWS) and out.columns == odd.columns)
            assert n > 0 or rows is not odd


def test_stages_keep_what_they_should(spark, sf):
    import corpus_pipeline

    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    near = " ".join(f"w{i}" for i in range(300))
    rows = [(1, near), (2, near.replace("w150", "changed")), (3, "something else " + " ".join(f"v{i}" for i in range(80))), (4, near), (5, f"before {item} after"), (6, "plain words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda d: sorted(r["doc_id"] for r in d.collect())
    assert ids(corpus_pipeline.exact_dedup_stage(spark, df, sf)) == [1, 2, 3, 5, 6]
    assert ids(corpus_pipeline.simhash_stage(spark, df, sf)) == [1, 3, 5, 6]
    assert ids(corpus_pipeline.decontamination_stage(spark, df, sf)) == [1, 2, 3, 4, 6]


def test_exact_dedup_beyond_its_broadcast_bounds(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(docs, digest=True).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "broadcast_if_small", lambda d: d)
    assert sorted(map(str, exact_dedup.exact_dedup(docs, digest=True).collect())) == want


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = lambda: sorted((r["doc_id"], x["item_id"], x["score"]) for r in decontam.decontaminate(docs, bench).collect() for x in r["leaks"])
    want = found()
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 200)
    assert found() == want and want


def _jaccard_groups(texts: list[str], words: int, least: float) -> list[int]:
    """By brute force: the smallest row number of each text's component."""
    sets = [{tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]) - 1e-12:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def _edited(words: list[str], n: int, rng) -> list[str]:
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**9)}"
    return out


def _components(spark, texts: list[str]) -> list[int]:
    import corpus_pipeline

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash_bk.near_duplicates(df, **corpus_pipeline.NEAR).collect()}
    return [got[i] for i in range(len(texts))]


def test_isolated_pairs_are_all_found(spark):
    """Groups of two at similarities around 0.8, where fingerprints alone miss most."""
    import random

    rng, texts = random.Random(5), []
    for k in range(240):
        size, edits = ((104, 1 + k % 4), (404, 6 + k % 10), (24, k % 3))[k % 3]
        base = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        texts += [" ".join(base), " ".join(_edited(base, edits, rng))]
    want = _jaccard_groups(texts, 5, 0.8)
    assert 60 < sum(want[2 * k] == want[2 * k + 1] for k in range(240)) < 230
    assert _components(spark, texts) == want


def test_families_near_the_threshold(spark):
    """Links are verified before they join: a failing link never stands in for one that would hold."""
    import random

    rng, texts = random.Random(6), []
    for _ in range(12):
        base = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        texts += [" ".join(_edited(base, rng.randrange(1, 4), rng)) for _ in range(20)]
    assert _components(spark, texts) == _jaccard_groups(texts, 5, 0.8)


def test_large_shard_ends_with_one_row_in_the_next_batch(spark):
    most, batch, parts = 40, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (batch, parts)}
    try:
        spark.conf.set(batch, str(most + 1))
        spark.conf.set(parts, "1")
        rows = [(k << 4, 15) for k in range(most + 2)] + [(1 + (k << 4), 15) for k in range(3)]
        got = simhash_bk._shard_links(spark.createDataFrame(rows, "fp long, mask long"), 4, most).where("mask is not null").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["a"] for r in got) == [k << 4 for k in range(most + 2)]


def test_html_keeps_articles_after_icons_and_in_marked_wrappers():
    tree = html_blocks.grow_tree(list(html_blocks.LABELLED))
    body = "<article><h1>Head</h1><p>" + "These are the words of an article that should stay. " * 5 + "</p></article>"
    want = html_blocks.main_text(body, tree)
    assert want.startswith("Head")
    for icon in ('<svg class="i" viewBox="0 0 1 1"/>', "<svg/>", "<svg-icon name='x'></svg-icon>", "<select-box></select-box>", "<title-bar/>"):
        assert html_blocks.main_text(icon + body, tree) == want, icon
    assert html_blocks.main_text("<svg viewBox='0 0 1 1'><text>no</text></svg>" + body, tree) == want
    for name in ("page with-sidebar", "no-comments", "form header"):
        assert html_blocks.main_text(f"<div class='{name}'><p>Menu</p>{body}<div class='comments'><article><p>I liked it a lot.</p></article></div></div>", tree) == want, name
    # where the page has another main element, marked wrappers stay boilerplate
    assert html_blocks.main_text(f"{body}<div class='comments'><article><p>I liked it a lot, all of it.</p></article></div>", tree) == want


def test_simhash_stage_on_repeated_and_null_ids(spark, sf):
    import corpus_pipeline

    near = [" ".join([*(f"n{k}" for k in range(100)), f"end{i}"]) for i in range(6)]
    nulls = [" ".join([*(f"m{k}" for k in range(100)), f"end{i}"]) for i in range(2)]
    rows = [(1, near[0]), (2, near[1]), (2, "a clean text of its own with other words"), (1, near[2]), (None, near[3]), (None, nulls[0]), (None, nulls[1]), (None, "alone with a null id here")]
    got = [tuple(r) for r in corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()]
    assert len(got) == 4
    assert sum(t in near and i == 1 for i, t in got) == 1 and rows[2] in got and rows[7] in got
    assert sum(t in nulls for _, t in got) == 1


def test_decontamination_of_short_and_repetitive_items(spark):
    item = [f"w{k}" for k in range(16)]
    copy = [*item[:3], "x", *item[4:6], "x", *item[7:9], "x", *item[10:12], "x", *item[13:15], "x"]  # one trigram is left
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "so " * 6), (3, "na " * 40)], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(copy)), (2, "so " * 6), (3, "na " * 40), (4, "nothing of them")], "doc_id long, text string")
    score, _ = decontam.align(*(decontam.Items([(0, " ".join(item))]).numbers(t) for t in (" ".join(item), " ".join(copy))))
    assert score / 32 >= 0.5
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.decontaminate(df, bench).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: []}
