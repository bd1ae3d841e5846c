"""SimHash near-duplicates: 64-bit fingerprints, BK-trees over shards, connected components.

Every distinct fingerprint goes to the shards named by AGREE of BLOCKS bit blocks: two fingerprints within
the radius differ in at most radius blocks, so they agree in at least BLOCKS - radius and share a shard.  A
shard's tree (children keyed by their integer Hamming distance to the parent) is walked for each member,
along edges within the radius of the distance to the node, before the member is added to it.  The tree is
sent to the task that holds the shard's queries and to no other: sending every tree to every task would
compare all with all.  A shard reports links that join two of its groups (a spanning forest), never all
pairs.  BLOCKS grows with the count of fingerprints, and a shard that is still too large (near copies that
share most bits) is split by further agreeing bits, so no task ever holds more than SHARD of them.

Components come from alternating large-star and small-star steps on joins and partial aggregates.  Copies
were one fingerprint from the start.  Nothing of corpus size reaches the driver.

Edge cases: null and empty texts have fingerprint 0 and are linked like any other; a text of fewer words
than a shingle is one shingle; null ids get the component of their text, and never name one unless all ids
of it are null; repeated rows come out as often as they came in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_texts, written

LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Texts in which common shingles are counted, and shingles held as common: both only for the order of prefixes.
SAMPLE, COMMON = 8000, 200_000
#: Fingerprints in a shard beyond which it is split; nodes that share a shingle beyond which they are dealt out; rows of a batch.
SHARD, GROUP, BATCH = 4096, 4096, 65_536
#: Shingles held by a task that tests pairs (eight bytes each).
HELD = 4_000_000
#: radius -> (blocks, agree) up to so many distinct fingerprints, then the next wider choice.
LAYOUTS = {4: ((6, 2, 1 << 27), (7, 3, 1 << 33), (8, 4, 1 << 62)), 6: ((8, 2, 1 << 22), (9, 3, 1 << 27), (10, 4, 1 << 62))}


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(ws) <= words:
        return np.array([h(b" ".join(ws), seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in ws])
    line = b" ".join(ws)
    starts = np.concatenate(([0], ends[:-1]))[: len(ws) - words + 1].tolist()
    stops = (ends - 1)[words - 1 :].tolist()
    return np.fromiter((h(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes; counted in blocks to bound memory."""
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """An independent hash of the same shingles (a splitmix step); k = 0 leaves them."""
    if k == 0:
        return hashes
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def set_key(shingles: np.ndarray) -> int:
    """One number of a shingle set (sorted, distinct): texts with equal sets are one node."""
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), 7))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two shingle sets (sorted, distinct)."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / union if (union := len(x) + len(y) - both) else 1.0


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", words: int = 4, count: int = 1, sets: bool = False) -> DataFrame:
    """keep columns and fp0, fp1, ... (signed 64-bit); with sets, the key of the shingle set (node)."""

    def run(texts: list) -> dict[str, list]:
        out: dict[str, list] = {f"fp{k}": [] for k in range(count)} | {"node": []}
        for t in texts:
            h = shingle_hashes(t, words)
            for k in range(count):
                out[f"fp{k}"].append(_signed(fingerprint(_mixed(h, k))))
            out["node"].append(set_key(np.unique(h)) if sets else None)
        return out

    return map_texts(docs, text_col, keep, run, ", ".join(f"fp{k} long" for k in range(count)) + ", node long")


def sketch(shingles: np.ndarray) -> bytes | None:
    """How many of a set's shingles fall into each of half as many buckets (by their last bits); None if a bucket overflows."""
    buckets = 1 << max(6, (len(shingles) // 2 - 1).bit_length() if len(shingles) > 2 else 0)
    counts = np.bincount((shingles & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def may_be_similar(x: bytes | None, y: bytes | None, least: float) -> bool:
    """False only if the sets of two sketches cannot be similar enough: buckets bound what they have in common."""
    if x is None or y is None:
        return True
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    total = int(a.sum() + b.sum())
    m = min(len(a), len(b))
    common = int(np.minimum(a.reshape(-1, m).sum(0), b.reshape(-1, m).sum(0)).sum())
    return common >= least / (1 + least) * total - 1e-9


def possible_links(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose sketches allow the similarity: a safe filter before texts move.  sketches: node, sketch."""
    s = lambda name, to: sketches.select(F.col("node").alias(name), F.col("sketch").alias(to))
    both = pairs.join(s("a", "x"), "a").join(s("b", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = pa.array([may_be_similar(x.as_py(), y.as_py(), least) for x, y in zip(t.column("x"), t.column("y"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(ok), t.column("b").filter(ok)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_links(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those links (a, b) whose texts' full shingle sets are at least so similar.  texts: node, text."""
    t = lambda name, to: texts.select(F.col("node").alias(name), F.col("text").alias(to))
    both = pairs.join(t("a", "x"), "a").join(t("b", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # sets of nodes seen lately: a node's pairs stand together
        size = 0

        def own(node: int, text: pa.StringScalar) -> np.ndarray:
            nonlocal size
            got = held.get(node)
            if got is None:
                got = np.unique(shingle_hashes(text.as_py(), words))
                if size + len(got) > HELD:
                    held.clear()
                    size = 0
                held[node] = got
                size += len(got)
            return got

        for t in batches:
            rows = zip(t.column("a").to_pylist(), t.column("x"), t.column("b").to_pylist(), t.column("y"))
            ok = pa.array([jaccard(own(a, x), own(b, y)) >= least for a, x, b, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(ok), t.column("b").filter(ok)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set in one global order (by count, then hash), so many that two sets with a
    similarity of least or more always share one of theirs."""
    n = len(shingles)
    where = np.minimum(np.searchsorted(common, shingles), max(0, len(common) - 1))
    seen = np.where(common[where] == shingles, counts[where], 0) if len(common) else np.zeros(n, np.int64)
    return shingles[np.lexsort((shingles, seen))][: n - math.ceil(least * n - 1e-9) + 1 if n else 0]


def common_shingles(docs: DataFrame, text_col: str, words: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles found again and again in about SAMPLE texts.

    They only come late in the order of prefix(); the links do not hang on them, but the time does.
    """
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(max(1, n // SAMPLE))) == 0).select(F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), words)).view(np.int64))], names=["h"])

    often = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON)
    rows = sorted((r["h"] & (2**64 - 1), r["n"]) for r in often.toLocalIterator())  # at most COMMON rows
    return np.array([h for h, _ in rows], np.uint64), np.array([c for _, c in rows], np.int64)


def _by_key(df: DataFrame, schema: str, run: Callable[[np.ndarray], Iterable[np.ndarray]]) -> DataFrame:
    """Applies run to the rows (columns x rows, the first column is the key) of each key; long columns only.

    What run yields goes out in batches of about BATCH rows, so no key's result is ever held as a whole.
    """
    cols = df.columns
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.concatenate(([0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1, [rows.shape[1]]))
            found: list[np.ndarray] = []
            size = 0
            for i in np.flatnonzero(np.diff(edges) > 1):
                for got in run(rows[:, edges[i] : edges[i + 1]]):
                    found.append(got)
                    size += got.shape[1]
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], names=names)
                        found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols])
            if held and held[-1][0, -1] != rows[0, 0]:
                yield from done(np.concatenate(held, axis=1))
                held = []
            if rows[0, 0] != rows[0, -1]:
                at = int(np.flatnonzero(rows[0] != rows[0, -1])[-1]) + 1
                yield from done(np.concatenate([*held, rows[:, :at]], axis=1))
                held, rows = [], rows[:, at:]
            held.append(rows)
        if held:
            yield from done(np.concatenate(held, axis=1))

    return df.repartition(cols[0]).sortWithinPartitions(*cols[:2]).mapInArrow(each, schema)


def _may_join(sizes: np.ndarray, i: int, least: float) -> np.ndarray:
    """Of the rows after i of a key (sizes: n << 32 | place), those whose set can be similar enough if this is the first shingle shared."""
    n, at = sizes >> 32, sizes & 0xFFFFFFFF
    rest = np.minimum(n[i] - at[i], n[i + 1 :] - at[i + 1 :])  # this shingle and all after it
    small, big = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
    return (small >= least * big - 1e-9) & (rest >= least / (1 + least) * (small + big) - 1e-9)


def shared_prefixes(docs: DataFrame, text_col: str, words: int, least: float, n: int) -> DataFrame:
    """key, node, size: sets that share a shingle of their prefixes with another; size is n << 32 | place in the order."""
    common, counts = common_shingles(docs, text_col, words, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                own = np.unique(shingle_hashes(t.as_py(), words))
                keys = prefix(own, common, counts, least)
                if len(keys):
                    sizes = (len(own) << 32) | np.arange(len(keys), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), set_key(own), np.int64)), pa.array(sizes)], names=["key", "node", "size"])

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "key long, node long, size long")
    rows = rows.groupBy("key", "node").agg(F.min("size").alias("size"))  # a set's repeats are one node
    # size is asked for on both sides, so that both read one shuffle and the texts are mapped once
    several = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("s")).where("n > 1 and s >= 0").select("key")
    return rows.join(several, "key", "left_semi")


def _spread_keys(rows: DataFrame) -> DataFrame:
    """part and the columns of rows, so that all nodes of a key that may pair share a part.

    A key of over GROUP nodes is dealt into chunks, and a node goes to the parts of its chunk with each chunk:
    every two nodes meet in one part, which holds no more than about two chunks.  side: the node's chunk.
    """
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key", F.ceil(F.col("n") / GROUP).cast("long").alias("chunks"))
    rows = rows.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return rows.withColumn("part", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")))


def prefix_pairs(shared: DataFrame, roots: DataFrame, least: float, star: bool) -> DataFrame:
    """a, b: pairs of nodes of different roots that share a prefix shingle and can be similar enough.

    With star, only those with the first node of a key's part, which is enough for most of a large group.
    """
    rows = shared.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    rows = _spread_keys(rows).select("part", "node", "key", "size", "root", "side")

    def pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
        _, node, key, size, root, side = rows
        if (root == root[0]).all():
            return
        mixed = (side != side[0]).any()
        for i in range(1 if star else len(node) - 1):
            ok = _may_join(size, i, least) & (root[i + 1 :] != root[i]) & (key[i + 1 :] == key[i])
            if mixed and not star:
                ok &= side[i + 1 :] != side[i]  # those of one chunk meet in its own part
            if len(other := node[i + 1 :][ok]):
                yield np.stack([np.minimum(node[i], other), np.maximum(node[i], other)])

    return _by_key(rows, "a long, b long", pairs).distinct()


def block_masks(blocks: int, agree: int) -> list[int]:
    """Masks (signed) of the bits that must agree, one for each choice of blocks."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(blocks)]
    return [_signed(sum(block[k] for k in c)) for c in combinations(range(blocks), agree)]


def tree_links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (Hamming distance <= radius) among distinct fingerprints, by a BK-tree."""
    parent = {members[0]: members[0]}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    root: tuple[int, dict] = (members[0], {})
    for fp in members[1:]:
        parent[fp] = fp
        stack, home, near = [root], None, []
        while stack:
            value, children = stack.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                near.append((d, value))
            for edge in range(d - radius, d + radius + 1) if len(children) > 2 * radius + 1 else children:
                if edge in children and d - radius <= edge <= d + radius:
                    stack.append(children[edge])
        for _, value in sorted(near):  # the closest member of each group makes the link
            if (a := find(value)) != (b := find(fp)):
                parent[max(a, b)] = min(a, b)
                out.append((value, fp))
        node = root
        while node is not None:  # down to the free place
            d = (node[0] ^ fp).bit_count()
            home, node = node, node[1].get(d)
        home[1][d] = (fp, {})
    return out


def narrower(mask: int, radius: int) -> list[int]:
    """Masks that each add one of radius + 1 parts of the free bits: a pair within the radius agrees in one."""
    free = [b for b in range(64) if not (mask >> b) & 1]
    cuts = [round(len(free) * k / (radius + 1)) for k in range(radius + 2)]
    return [_signed((mask & (2**64 - 1)) | sum(1 << b for b in free[lo:hi])) for lo, hi in zip(cuts, cuts[1:])]


def _shard_links(keyed: DataFrame, radius: int, most: int) -> DataFrame:
    """f, a, b, mask of every shard's spanning links (mask null); members of shards over most as (f, fp, fp, mask).

    keyed: f (which fingerprint), fp, mask.  Rows stream through in order of shard, so a task holds one shard of
    at most that size.
    """
    order = ("f", "mask", "k")
    if "f" not in keyed.columns:
        keyed = keyed.withColumn("f", F.lit(0).cast("long"))
    dealt = keyed.withColumn("k", F.col("fp").bitwiseAND(F.col("mask"))).repartition(*order).sortWithinPartitions(*order, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << 64) - 1
        held = np.zeros((4, 0), np.int64)  # rows of the last shard, which may go on in the next batch
        passed: tuple[int, int, int] | None = None  # the large shard that is being passed on

        def packed(f: np.ndarray, a: np.ndarray, b: np.ndarray, mask: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(f), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if mask is None else pa.array(mask)], names=["f", "a", "b", "mask"])

        def shards(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """rows: whole shards."""
            nonlocal passed
            f, m, _, fp = rows
            cut = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
            edges = np.concatenate(([0], cut, [len(m)]))
            sizes = np.diff(edges)
            found: list[tuple[int, int, int]] = []
            alone = sizes == 1
            alone[0] &= passed is None  # one row may be the rest of the shard that is being passed on
            for i in np.flatnonzero(~alone):
                at = slice(edges[i], edges[i + 1])
                if sizes[i] > most or passed == tuple(rows[:3, edges[i]].tolist()):
                    yield packed(f[at], fp[at], fp[at], m[at])
                elif sizes[i] > 1:
                    found += [(int(f[edges[i]]), *sorted((_signed(a), _signed(b)))) for a, b in tree_links([int(x) & low for x in fp[at]], radius)]
            if found:
                yield packed(*np.array(found, np.int64).T, None)

        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (*order, "fp")])], axis=1)
            if rows.shape[1] == 0:
                continue
            tail = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(0))
            at = tail[-1] + 1 if len(tail) else 0
            if at:
                yield from shards(rows[:, :at])
                passed = None if passed != tuple(rows[:3, -1].tolist()) else passed
            held = rows[:, at:]
            if held.shape[1] > most or (held.shape[1] and passed == tuple(held[:3, 0].tolist())):
                passed = tuple(held[:3, 0].tolist())
                yield packed(held[0], held[3], held[3], held[1])
                held = held[:, :0]
        if held.shape[1]:
            yield from shards(held)

    return dealt.select(*order, "fp").mapInArrow(run, "f long, a long, b long, mask long")


def links(distinct: DataFrame, radius: int, blocks: int, agree: int, most: int = SHARD, rows: int | None = None) -> DataFrame:
    """f, a, b (a < b): links that span, within every shard, its groups of fingerprints.  distinct: f, fp.

    f tells fingerprints of different hashes apart: all go through one pass.  The members of a shard of over
    most fingerprints go on to narrower shards, again and again if need be: each step fixes more bits, so the
    steps end, and no link is lost.  Without f there is one fingerprint.
    """
    if most < 2 ** (radius + 1):
        raise ValueError("shards must have room for radius + 1 free bits, or splitting them would not end")
    if "f" not in distinct.columns:
        distinct = distinct.select(F.lit(0).cast("long").alias("f"), "fp")
    keyed = distinct.select("f", "fp", F.explode(F.array(*(F.lit(m).cast("long") for m in block_masks(blocks, agree)))).alias("mask"))
    found = None
    while True:
        out = written(_shard_links(keyed, radius, most), "simhash-links", rows)
        near = out.where("mask is null").select("f", "a", "b")
        found = near if found is None else found.union(near)
        large = out.where("mask is not null")
        masks = [r["mask"] for r in large.select("mask").distinct().toLocalIterator()]  # at most some thousand masks
        if not masks:
            return found.distinct()
        parts = distinct.sparkSession.createDataFrame([(m, c) for m in masks for c in narrower(m, radius)], "mask long, part long")
        keyed = large.select("f", F.col("a").alias("fp"), "mask").join(F.broadcast(parts), "mask").select("f", "fp", F.col("part").alias("mask"))


def components(edges: DataFrame, name: str = "star", rows: int | None = None) -> DataFrame:
    """node, root (the smallest node of the component) for every node of edges (a, b with a < b).

    Alternates large-star and small-star until nothing changes; every round is one written table.  Neighbours
    are never gathered: a node's smallest neighbour is a partial aggregate that is joined back.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges", rows)
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")).first()
        if now == before and now[0] == now[2]:  # nothing changed, and every node hangs on its root alone
            roots = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        down = both.where("v > u").join(low, "u").where("m <> v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # v < u
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        edges = written(small, f"{name}-edges", rows)


def layout(radius: int, n: int) -> tuple[int, int]:
    return next((b, a) for b, a, most in LAYOUTS[radius] if n <= most)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, count: int = 1, least: float | None = None) -> DataFrame:
    """One row per row of docs: id, fp0.., component (smallest id reachable by links).

    With count > 1, fingerprints of independent hashes, two texts link if any of theirs do.  With least, two
    texts link if and only if the Jaccard similarity of their full shingle sets is at least that (see
    similar_components); text_hash and root, which names the group its smallest node), are added.
    """
    names = [f"fp{k}" for k in range(count)]
    exact = least is not None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    n = docs.count()
    fps = written(fingerprints(rows, ("id", "text_hash"), "text", words, count, exact).select("id", "text_hash", *names, "node"), "simhash-fps")  # as many tasks as the texts have
    key = ["node"] if exact else names
    nodes = fps.groupBy(*key).agg(F.min("id").alias("m"), *([F.min(n).alias(n) for n in names] + [F.min("text_hash").alias("text_hash")] if exact else []))
    # a node is one shingle set, else one text class; its number is fp0 where that is unique, which with one fingerprint it always is
    nodes = written(nodes if exact else nodes.withColumn("node", F.col("fp0") if count == 1 else F.xxhash64(*names)), "simhash-nodes", n)
    blocks, agree = layout(radius, n)
    long = nodes.select("node", F.posexplode(F.array(*names)).alias("f", "fp")).withColumn("f", F.col("f").cast("long"))
    found = links(long.select("f", "fp").distinct(), radius, blocks, agree, rows=n)
    if count == 1 and not exact:
        found = found.select("a", "b")
    else:  # from fingerprints to nodes; nodes with one fingerprint in common are linked to its smallest
        at = long.groupBy("f", "fp").agg(F.min("node").alias("node"))
        near = found.join(at.select("f", F.col("fp").alias("a"), F.col("node").alias("x")), ["f", "a"]).join(at.select("f", F.col("fp").alias("b"), F.col("node").alias("y")), ["f", "b"])
        same = long.select("f", "fp", F.col("node").alias("y")).join(at.select("f", "fp", F.col("node").alias("x")), ["f", "fp"])
        found = near.select("x", "y").union(same.select("x", "y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    roots = similar_components(rows, nodes, written(found, "simhash-found", n), words, least, n) if exact else components(found, "simhash", n)
    linked = written(nodes.select("node", "m").join(roots, "node"), "simhash-linked", n)
    named = linked.join(linked.groupBy("root").agg(F.min("m").alias("c")), "root").select("node", "root", "c")
    smallest = nodes.join(named, "node", "left").select(*key, F.coalesce("c", "m").alias("component"), *([F.coalesce("root", "node").alias("root")] if exact else []))
    return fps.join(smallest, key, "left").select("id", *names, "component", *(["text_hash", "root"] if exact else []))


def similar_components(rows: DataFrame, nodes: DataFrame, found: DataFrame, words: int, least: float, n: int) -> DataFrame:
    """node, root: components of all pairs of shingle sets with a similarity of at least least, by exact tests.

    The fingerprints' links (found) are tested first and join most near copies.  What they miss shares a
    shingle of the two prefixes: such pairs of different roots are tested too, first with one node of every
    shared shingle, then all of those that are still in different components.  No pair is left out, but sketches
    refuse pairs that cannot be similar enough before texts move.
    """
    shared = written(shared_prefixes(rows, "text", words, least, n), "simhash-shared", 8 * n)
    wanted = found.select(F.explode(F.array("a", "b")).alias("node")).union(shared.select("node")).distinct()
    wanted = written(wanted.join(nodes.select("node", "text_hash"), "node").select("node", "text_hash"), "simhash-wanted", n)
    texts = rows.select("text_hash", "text").join(broadcast_if_small(wanted), "text_hash").select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "simhash-texts")  # wide: in as many tasks as adaptive execution gives their shuffle
    sketches = map_texts(texts, "text", ("node",), lambda ts: {"sketch": [sketch(np.unique(shingle_hashes(t, words))) for t in ts]}, "sketch binary")
    sketches = written(sketches, "simhash-sketches")

    def tested(pairs: DataFrame) -> DataFrame:
        likely = written(possible_links(pairs, sketches, least), "simhash-likely", n)
        return written(similar_links(likely, texts, words, least), "simhash-good", n)

    good = tested(found)
    roots = written(components(good, "simhash", n), "simhash-roots", n)
    for star in (True, False):
        more = tested(prefix_pairs(shared, roots, least, star))
        if more.head(1):
            good = good.union(more)
            roots = written(components(good, "simhash", n), "simhash-roots", n)
    return roots


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
