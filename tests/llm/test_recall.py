"""Planted cases: edited benchmark copies, similar personal data, odd pages, near duplicates by band, license texts."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowproof.llm import common, decontam, exact_dedup, html_blocks, license_rules, license_scan, mixing, pii_crf, simhash_bk, toxicity_fm
from rowproof.llm import queries as Q


def edited(words, rate, rng):
    """Substitutions, insertions and deletions in equal parts."""
    out = []
    for w in words:
        kind = rng.random() / rate if rate else 9
        if kind < 1 / 3:
            out.append(f"sub{rng.randrange(9999)}")
        elif kind < 2 / 3:
            out += [w, f"ins{rng.randrange(9999)}"]
        elif kind >= 1:
            out.append(w)
    return out


def test_edited_benchmark_copies_are_found(spark, sf):
    """Of copies with 5 to 25 % of the words edited, each at a random place of another text, at least 0.9 are found."""
    rng = random.Random(11)
    items = [r for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len((r["text"] or "").split()) >= 8][:80]
    rows = []
    for rate in (0.0, 0.05, 0.15, 0.25):
        for r in items:
            around = [f"w{rng.randrange(5000)}" for _ in range(200)]
            at = rng.randrange(200)
            rows.append((f"{rate}:{r['item_id']}", " ".join(around[:at] + edited(r["text"].split(), rate, rng) + around[at:])))
    found = decontam.decontaminate(spark.createDataFrame(rows, "doc_id string, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    hits = Counter()
    for r in found:
        rate, item = r["doc_id"].split(":")
        hits[rate] += int(item) in {x["item_id"] for x in r["leaks"]}
    assert hits["0.0"] == len(items)
    assert all(hits[rate] >= 0.9 * len(items) for rate in ("0.05", "0.15", "0.25")), hits


def test_item_ids_of_other_types(spark):
    text = "one two three four five six seven eight nine ten"
    got = decontam.decontaminate(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), spark.createDataFrame([("a/7", text), ("b", None)], "item_id string, text string")).collect()
    assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in got} == {1: ["a/7"], 2: []}


def test_similar_personal_data(spark):
    """Planted repeats that the patterns miss: without country code, one digit changed, a cut address."""
    field = pii_crf.train_field(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(5)
    caught = clean = 0
    for _ in range(100):
        number = "".join(rng.choice("123456789") for _ in range(9))
        other = "".join(rng.choice("123456789") for _ in range(9))
        name = "".join(rng.choice("abcdefgh") for _ in range(7))
        text = f"Call +49{number} today. Word {other} follows after a while. Again 0{number} and write to {name}@mail.example.org, {name}@mail."
        base, added = pii_crf.all_spans(text, field)
        got = {text[a:b] for _, a, b in added}
        assert {text[a:b] for _, a, b in base} >= {f"+49{number}", f"{name}@mail.example.org"}
        caught += (f"0{number}" in got) + (f"{name}@mail" in got)
        clean += other not in got
    assert caught >= 180 and clean >= 95
    lonely = pii_crf.Field(field.unary, field.chain, np.zeros_like(field.skip))
    assert not pii_crf.all_spans("Call +49123456789 now, or 0123456789.", lonely)[1]


PARA = "word " * 40


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<article><p>{PARA}</p><p class="advert">buy now</p><p class="cookie-notice">we use cookies</p><p class="comment">first</p></article>', [PARA]),
        (f'<article><section class="legal"><p>{PARA}</p></section><div class="social-science"><p>one more</p></div><div class="card-header">A title</div></article>', [PARA, "one more", "A title"]),
        (f'<article><p data-x="{"a>b" * 3000}">{PARA}</p></article>', [PARA]),
        (f'<a href="x"><div>One</div><div>Two things</div></a><a href="y"><div>Three</div></a><article><p>{PARA}</p></article>', [PARA]),
        (f'<div class="menu"><a href="1">Home</a></div><div><h1>A title of five words</h1><p>{PARA}</p><p>Short.</p><p>{PARA}</p></div><div class="footer">Copyright me</div>', ["A title of five words", PARA, "Short.", PARA]),
        (f'<article><p title="abc>{PARA}</p><p>end</p></article>', [PARA, "end"]),
        (f'<article><h1><a href="/t">A title</a></h1><p>Ten words.</p><p>{PARA}</p><ul><li><a href="1">One more page</a></li><li><a href="2">Two more pages</a></li><li><a href="3">Three</a></li></ul></article>', ["A title", "Ten words.", PARA]),
        (f'<body class="page with-sidebar"><div class="sidebar"><p>{PARA}</p></div><main><p>{PARA}</p></main></body>', [PARA]),
        ("", []),
        (None, []),
    ],
)
def test_odd_pages(page, want):
    tree = html_blocks.grow_tree(html_blocks.labelled_blocks())
    assert html_blocks.main_text(page, tree) == "\n\n".join(w.strip() for w in want)


STORY = "Some plain words of a paragraph that is long enough to be the text of a story, with more in it. " * 3
BODY = f"<h1>The title of a story</h1><p>{STORY}</p><p>{STORY}</p><p>Short one.</p><p>{STORY}</p>"
LIKED = "<p>I liked this a lot, thank you for it.</p>"


@pytest.mark.parametrize(
    "page, same",
    [
        (f"<div class='story comments-open'>{BODY}</div>", BODY),
        (f"<div class='content ad-free'>{BODY}</div>", BODY),
        (f"<div id='page' class='newsletter-archive'>{BODY}</div>", BODY),
        (f"<article>{BODY}<section id='overlay-networks'><p>{STORY}</p></section></article>", f"{BODY}<p>{STORY}</p>"),
        (f"<article>{BODY}<section id='reply'><p>{STORY}</p></section></article>", f"{BODY}<p>{STORY}</p>"),
        (f"<article>{BODY}<div class='notice-board-history'><p>{STORY}</p></div></article>", f"{BODY}<p>{STORY}</p>"),
        (f"<article>{BODY}<article class='comment'>{LIKED}</article></article>", BODY),
        (f"<article>{BODY}<article>{LIKED}</article></article>", BODY),
        (f"<article>{BODY}</article><section><h2>Comments</h2><article>{LIKED}</article><article>{LIKED}</article></section>", BODY),
        (f"<article>{BODY}</article><div><h3>2 Kommentare</h3><article>{LIKED}</article></div>", BODY),
        (f"<article><article>{BODY}</article></article>", BODY),
        (f"<article>{BODY}<div class='story-comments'>{LIKED}</div><div class='newsletter-signup-box'>{LIKED}</div><div class='ad-slot-2'>{LIKED}</div></article>", BODY),
        (f"<article><h2>Comments</h2>{BODY}</article>", f"<h2>Comments</h2>{BODY}"),
    ],
)
def test_words_of_classes_are_weighed(page, same):
    tree = html_blocks.grow_tree(html_blocks.labelled_blocks())
    assert html_blocks.main_text(page, tree) == html_blocks.main_text(f"<article>{same}</article>", tree) != ""


def test_pages_without_main_element():
    """Generated pages without article or main, of which half have a wrapper with a word of boilerplate: words found and words wrongly kept."""
    rng = random.Random(17)
    tree = html_blocks.grow_tree(html_blocks.labelled_blocks())
    say = lambda lo, hi, stem: " ".join(f"{stem}{rng.randrange(10**6)}" for _ in range(rng.randint(lo, hi)))
    hit = all_main = kept = 0
    for k in range(60):
        link = lambda: f"<a href='#'>{say(1, 3, 'x')}</a>"  # noqa: B023,E731
        text = f"<h1>{say(4, 9, 'm')}</h1>" + "".join(f"<h2>{say(2, 5, 'm')}</h2>" if rng.random() < 0.15 else f"<p>{say(20, 90, 'm')}</p>" for _ in range(rng.randint(4, 12)))
        wrapper = rng.choice(["story comments-open", "ad-free", "newsletter-archive", "promo-disabled page", "popup-blocker-guide"]) if k % 2 else rng.choice(["", "content", "post", "entry"])
        after = "".join(
            rng.sample([f"<div class='sidebar'><p>{say(10, 40, 'x')}</p></div>", f"<div class='post-comments'><p>{say(5, 60, 'x')}</p><p>{say(5, 60, 'x')}</p></div>", f"<div class='related'>{link()}<hr>{link()}<hr>{link()}</div>", f"<div class='cookie-notice'>{say(8, 20, 'x')}</div>"], 2)
        )
        page = f"<nav><ul>{''.join(f'<li>{link()}</li>' for _ in range(5))}</ul></nav><div class='{wrapper}'>{text}</div>{after}<footer>{say(3, 12, 'x')}</footer>"
        got = html_blocks.main_text(page, tree).split()
        kept += len(got)
        hit += sum(w[0] == "m" for w in got)
        all_main += sum(w[0] == "m" for w in html_blocks.re.sub("<[^>]*>", " ", text).split())
    assert hit >= 0.98 * all_main and hit >= 0.98 * kept, (hit, all_main, kept)


def test_the_tree_uses_neighbours_and_fits_its_blocks():
    rows = html_blocks.labelled_blocks()
    tree = html_blocks.grow_tree(rows)
    used = set()

    def walk(t):
        if t[0] is not None:
            used.add(html_blocks.FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert used & {"words_before", "density_before", "words_after", "density_after"}
    assert all((html_blocks.tree_says(tree, r) >= 0.5) == r[-1] for r in rows)


def test_long_and_broken_pages_are_read_in_linear_time():
    import time

    began = time.process_time()
    for page in ("<p>" + "<a '" * 200_000, '<p title="' * 100_000, "<" * 300_000, "<p a=\"" + "x' " * 200_000, "<div class=x>" * 50_000, "<!--" * 100_000, "<script>" * 100_000, "<div>" * 50_000 + "</b2>" * 50_000):
        html_blocks.blocks(page)
    assert time.process_time() - began < 20


def test_near_duplicate_recall_by_band(spark):
    """Pairs of sets at every similarity from 0.6 to 1, isolated: joined if and only if at 0.8 or more."""
    rng = random.Random(3)
    rows, truth = [], {}
    for k in range(240):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice((60, 150, 400)))]
        other = list(words)
        for i in rng.sample(range(len(words)), round(len(words) * (k % 12) * 0.004)):
            other[i] = f"v{rng.randrange(10**6)}"
        a, b = (np.unique(simhash_bk.shingle_hashes(" ".join(x), 5)) for x in (words, other))
        truth[2 * k] = simhash_bk.jaccard(a, b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r["id"]: r["component"] for r in simhash_bk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **corpus_pipeline.NEAR).collect()}
    bands = defaultdict(list)
    for k, j in truth.items():
        joined = got[k + 1] == got[k]
        assert joined == (j >= 0.8), (k, j)
        bands[int(j * 20) / 20].append(joined)
    assert {0.8, 0.85, 0.9, 0.95} <= set(bands)


def test_sketches_never_refuse_a_similar_pair():
    rng = np.random.default_rng(1)
    refused = 0
    for k in range(600):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 700), dtype=np.uint64))
        keep = rng.random(len(a)) < rng.uniform(0.5, 1)
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**64, rng.integers(0, 60), dtype=np.uint64)]))
        if not len(b):
            continue
        ok = simhash_bk.may_be_similar(simhash_bk.sketch(a), simhash_bk.sketch(b), 0.8)
        assert ok or simhash_bk.jaccard(a, b) < 0.8
        refused += not ok
    assert refused > 100
    assert simhash_bk.sketch(np.zeros(0, np.uint64)) is not None and simhash_bk.sketch(np.arange(1, 2**20, 2**10, dtype=np.uint64)) is None


def test_hot_shingles_are_dealt_out_without_loss(spark, monkeypatch):
    """With groups limited to ten nodes, a family of ninety gives the same components."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for i in rng.sample(range(120), 3):
            words[i] = f"x{k}-{i}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [np.unique(simhash_bk.shingle_hashes(t, 5)) for _, t in rows]
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(90):
        for j in range(i):
            if simhash_bk.jaccard(sets[i], sets[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    want = {i: find(i) for i in range(90)}
    monkeypatch.setattr(simhash_bk, "GROUP", 10)
    got = {r["id"]: r["component"] for r in simhash_bk.near_duplicates(df, **corpus_pipeline.NEAR).collect()}
    assert got == want


def test_license_texts_are_known(spark):
    """An own table of sentences from license texts, independent of the rules' table."""
    cases = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including",
        "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "bsd-0-clause": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "gpl-3.0": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "cc0-1.0": "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights",
        "proprietary": "Unauthorized copying of this file, via any medium, is strictly prohibited",
    }
    df = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    for r in license_scan.license_digest(license_scan.license_scan(df)).collect():
        assert r["doc_id"] in r["labels"].split(","), r
    isc = [r for r in license_scan.license_scan(df).collect() if r["doc_id"] == "isc"][0]
    assert [x["label"] for x in isc["found"]] == ["isc"]  # the shorter notice lies within
    table = license_rules.rules()
    assert len({r[4] for r in table}) == len(table) > 400


def test_toxic_documents_are_found(spark):
    """Held-out rows that hold a word of the training rows' toxic documents only: recall and precision, not accuracy."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["predicted"]) for r in Q.op8_toxicity(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    hit, miss, false = (sum(g == x for g in got) for x in ((1, 1), (1, 0), (0, 1)))
    assert hit / (hit + miss) >= 0.9 and hit / (hit + false) >= 0.95


def test_toxicity_cut_has_about_the_largest_f1():
    """The cut against all cuts, with ties and weights; the map from logits to scores keeps their order."""
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(2, 30)
        z = np.array([rng.choice([-2.0, -1.5, 0.0, 0.25, 3.0, rng.uniform(-3, 3)]) for _ in range(n)])
        y = np.array([1.0, 0.0] + [float(rng.random() < 0.4) for _ in range(n - 2)])
        weight = np.where(y == 1, 1.0, 3.0)

        def f1(cut):
            called = z >= cut
            return 2 * (weight * y)[called].sum() / (weight[called].sum() + (weight * y).sum())

        best = max(map(f1, z))
        cut = toxicity_fm._cut(z, y, weight)
        assert f1(cut) >= best - toxicity_fm.SLACK and not any(f1(x) >= best - toxicity_fm.SLACK for x in z if x < cut)
    bad, good = ["you awful zorb people", "zorb scum awful"], ["a calm day", "the river runs", "people like tea"]
    sample = [(1, t) for t in bad * 6] + [(0, t) for t in good * 6]
    machine = toxicity_fm.fit_machine(sample)
    assert all(s >= toxicity_fm.AT for s in machine.scores(bad)) and all(s < toxicity_fm.AT for s in machine.scores([*good, "", None]))
    few = toxicity_fm.fit_machine(sample[10:])  # two labels of class 1: nothing is moved
    assert few.bias == toxicity_fm._learn(toxicity_fm._all_terms([t for _, t in sample[10:]]), np.array([y for y, _ in sample[10:]], float), toxicity_fm.WIDTH, 7).bias


def test_fit_samples_are_whole_and_bounded(spark):
    rows = [(i, ("a" if i % 2 else "b") * (10 + i)) for i in range(200)] + [(3, "another text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    one = common.labelled_sample(docs, labels, "quality", 5, 0, 50, 4000)
    assert one == common.labelled_sample(docs.repartition(7), labels, "quality", 5, 0, 50, 4000)
    assert {t for _, t, _ in one} <= {t for _, t in rows} and all(crc32(str(i).encode()) % 5 for *_, i in one)
    assert max(Counter(y for y, *_ in one).values()) <= 50 and all(sum(len(t) for y, t, _ in one if y == c) <= 4000 for c in (0, 1))


def test_exact_dedup_hashes_survivors_only(spark):
    rows = [(1, "short"), (2, "x" * 80), (3, "x" * 80), (4, "x" * 79 + "y"), (5, "y" * 80), (None, "x" * 80), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS len", "2 AS ph", "3 AS sha", "4 AS id", "5 AS _lost_id2")
    got = {r["id"]: r for r in exact_dedup.exact_dedup(df).collect()}
    assert len(got) == 8 and got[1]["sha"] is None and got[5]["sha"] is None and got[4]["sha"] is not None
    assert (got[3]["keep_id"], got[3]["group_size"], got[None]["kept"], got[4]["group_size"]) == (2, 3, False, 1)
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5, 7]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Exchange" in line or "Sort [" in line]
    assert keyed and not any("sha2" in line for line in keyed)  # the full hash is no key: it is taken where all else agrees


def test_rows_of_equal_beginning_and_length_stay(spark):
    same = "x" * 100
    rows = [(1, same), (1, same[:-1] + "y"), (1, same), (2, same), (2, same[:-1] + "z"), (None, same), (None, same[:-1] + "y")]
    kept = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"][-1]) for r in kept.collect()) == [(1, "x"), (1, "y"), (2, "z")]


def test_heavy_stages_keep_their_tasks(spark):
    """A table's few files are dealt by a shuffle after the rows are made; scratch folders of two threads are their own."""
    import threading

    made = spark.range(0, 1000, 1, 40).select(F.spark_partition_id().alias("task"))
    with common.scratch(spark):
        table = common.written(made, "some", 10)
        assert table.distinct().count() == 40 and len(table.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
        other = []
        thread = threading.Thread(target=lambda: other.append(common._scratch.get()))
        thread.start()
        thread.join()
        assert other == [None]


def test_mixing_orders_many_blocks_by_groups(spark, monkeypatch):
    """With groups of few blocks, the same blocks come in the same order."""
    df = spark.createDataFrame([(i, "s%d" % (i % 3 % 2), "w " * (50 + i % 7)) for i in range(600)], "doc_id long, source string, text string")
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    one = sorted(map(tuple, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "GROUP", 5)
    assert sorted(map(tuple, mixing.mix_sources(df).collect())) == one
    assert max(b for *_, b, _ in one) > 40


def test_components_of_long_chains_cliques_and_cycles(spark):
    edges = [(i, i + 1) for i in range(150)] + [(1000 + i, 1000 + j) for i in range(12) for j in range(i + 1, 12)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(8)] + [(2000, 2008)]
    got = {r["node"]: r["root"] for r in simhash_bk.components(spark.createDataFrame(edges, "a long, b long"), rows=400).collect()}
    assert got == {i: 0 for i in range(151)} | {1000 + i: 1000 for i in range(12)} | {2000 + i: 2000 for i in range(9)}


def test_scratch_tables_are_removed(spark):
    import os

    with common.scratch(spark):
        path = common.written(spark.range(10), "some", 10).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
