"""Long documents are cut a few at a time."""

import random

import pyarrow as pa

from rowproof.operators import documents as D


def test_parts_leave_python_a_few_texts_at_a_time(spark):
    rng = random.Random(4)
    text = lambda: "\n\n".join("word " * rng.randint(5, 60) for _ in range(300))
    rows = [(i if i else None, text() if i % 3 else "a\n \nb" if i % 2 else None) for i in range(120)] + [(500, "x" * 3_000_000), (501, "\n \n" * 1000)]
    out = list(D._cut(iter([pa.RecordBatch.from_pylist([{"_id": i, "_t": t or ""} for i, t in rows])]), 200, 1500))
    want = [(i, k, p) for i, t in rows for k, p in enumerate(D.split_paragraphs(t or "", 200, 1500) or [""])]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
    assert len(out) > 3 and all(b.nbytes < 2 * D.HELD_BYTES or len(set(b.column(0).to_pylist())) == 1 for b in out)
    cut = [(i, k, p) for i, k, p in want if len(dict(rows)[i] or "") > 1500]
    whole = [(i, 0, t or "") for i, t in rows if len(t or "") <= 1500]
    got = D.split_long(spark.createDataFrame(rows, "id long, text string"), "id", words=200, chars=1500)
    assert got.columns == ["id", "part", "text"] and sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, cut + whole))
