"""The ten queries against brute-force versions, over whole tables of the smallest scale."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
import xxhash

import corpus_pipeline
from compare import connect, same
from rowproof.llm import queries as Q


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracles(name, spark, sf):
    same(Q.queries()[name](spark, sf), connect(sf), Q.oracle_sql()[name])


def test_op1_against_all_alignments(spark, sf, docs):
    """Every document with a benchmark passage as a whole is found; every pair found scores as an own alignment does."""
    word = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {r["item_id"]: word(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in Q.op1_decontamination(spark, sf).collect()}
    whole = {(d, i) for d, t in docs.items() for line in [" " + " ".join(word(t)) + " "] for i, w in items.items() if w and " " + " ".join(w) + " " in line}
    assert whole <= set(got)
    for (d, i), score in list(got.items())[:10]:
        a, b = items[i], word(docs[d])
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
            row, best = new, max(best, max(new))
        assert score == pytest.approx(best / (2 * len(a)), abs=1e-6)


def test_op2_rules(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rules = Q.URL_RULES
    rows = Q.op2_url_reputation(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        rest = pages[r["page_id"]].partition("://")[2]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = host.lower()
        assert (r["host"], r["path"]) == (host, path)
        fit = [(len(t), t, v) for v, t in rules for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        if fit:
            assert (r["rule"], r["verdict"]) == max(fit)[1:]
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")


def test_op3_base(spark, sf, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in Q.op3_license_scan(spark, sf).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]] or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
        at = [(i, lb) for p, lb in phrases.items() for k in [p.split()] for i in range(len(words)) if words[i : i + len(k)] == k]
        labels = sorted({lb for _, lb in at})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(at), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(labels) <= set(r["labels"].split(",")) and list(r["labels"].split(",")) == sorted(set(r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_op5_is_exact(spark, sf, docs):
    norm = {d: re.sub("[\x20\x09-\x0d]+", " ", t or "") for d, t in docs.items()}
    group = defaultdict(list)
    for d, t in norm.items():
        group[t].append(d)
    for r in Q.op5_exact_dedup(spark, sf).collect():
        g = group[norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(g), len(g), r["doc_id"] == min(g))
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()


def simhash(text, n=4):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + n]), 42) for i in range(max(1, len(ws) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    ids = sorted(fps)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_op7_against_all_pairs(spark, sf, docs):
    fps = {d: simhash(t) for d, t in docs.items()}
    want = brute_components(fps)
    got = Q.op7_simhash(spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{x:016x}" for d, x in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("name, label, parts, held, least, accuracy", [("op4_quality", "quality", 5, 0, 0.3, 0.9), ("op8_toxicity", "toxic", 3, 1, 0.7, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, parts, held, least, accuracy):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.queries()[name](spark, sf).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % parts == held) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
    out = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in out) / len(out) >= accuracy


def base_spans(text):
    """The contract's patterns as they stand."""
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in tests for m in re.finditer(p, text) if ok(m[0])]


def test_op10_base(spark, sf, docs):
    for r in Q.op10_personal_data(spark, sf).collect():
        want = base_spans(docs[r["doc_id"]] or "")
        n = Counter(k for k, _, _ in want)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [n[k] for k in ("email", "ip", "card", "phone")]
        line = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert set(line) <= set(r["spans"].split(",")) | {""}


def test_op6_article_text(spark, sf):
    """The test pages keep their text in article: headings and paragraphs, and nothing else."""
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in Q.op6_html_extraction(spark, sf).collect():
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        parts = re.split(r"</?(?:p|h\d)>", body)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p) if "<br" in p else re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert r["text"] == "\n\n".join(p for p in want if p)
        assert r["n_chars"] == len(r["text"])


def test_op9_meets_its_budget(spark, sf, docs):
    from rowproof.llm import mixing

    rows = Q.op9_mixing(spark, sf).collect()
    total = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        total[r["source"]] += len((r["text"] or "").encode().split())
    used = Counter()
    seen = defaultdict(set)
    for r in rows:
        used[r["source"]] += r["tokens"]
        assert r["doc_id"] not in seen[r["epoch"]]  # a permutation: once an epoch
        seen[r["epoch"]].add(r["doc_id"])
    budget = sum(total.values())
    share = {s: t / budget for s, t in total.items()}

    def weights(a):
        z = sum(x**a for x in share.values())
        return {s: x**a / z for s, x in share.items()}

    import math

    entropy = lambda w: -sum(p * math.log(p) for p in w.values() if p)
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(weights(mid)) >= mixing.ENTROPY * math.log(len(share)) else (lo, mid)
    want = weights(round(lo, 4))
    for s, n in used.items():
        goal = want[s] * budget
        longest = max(len((t or "").split()) for t in docs.values())
        assert goal - longest - 1 <= n <= goal + 1 and n <= mixing.REPEATS * total[s]


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        n = docs.count()
        if k < 4:
            assert docs.columns == columns and 0 < n <= before and docs.select("doc_id").distinct().count() == n
            before = n
    assert corpus_pipeline.run(spark, sf).count() == n
