"""Near copies by similarity of word shingles: SimHash candidates, MinHash candidates beyond its radius, exact verification.

Two documents are near copies if the Jaccard similarity of their sets of
five-word shingles is 0.8 or more. Fingerprints of 64 bits cannot find them: at
0.8 SimHash differs in about 10 bits, in some pairs in 20, which no covering
family of usable size reaches. Besides pairs that SimHash links (`given`),
candidates therefore are those that share one of BANDS bands of ROWS minima; a pair at exactly 0.8 is missed with probability
(1 - 0.8**5)**40 = 1.2e-7, closer ones less often. Nothing is linked that is
not verified on the whole sets of shingles.

Pairs are never listed bucket by bucket. First every member of a bucket is
compared with its most central member, which connects nearly all of a group of
copies. Buckets in which documents are still apart make up clusters; there the
documents outside of the cluster's largest group are compared with all of it by
an inverted index of shingles, in blocks of bounded size, and only edges that
connect something leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_names, superseded, written

WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS, SEED = 40, 5, 42
#: Shingle hashes that are permuted at a time.
SPAN = 512
#: Documents, and 8 kB of shingles for each, of either side of a block of the last comparison.
BLOCK = 512

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = WIDTH) -> set[bytes]:
    """The shingles of a UTF-8 text: A-Z lower-cased, words between ASCII white space; a shorter text is one shingle."""
    words = text.lower().split()
    if len(words) < width:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least value of the hashes under each permutation."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(hashes), SPAN):
        low = np.minimum(low, (hashes[None, s : s + SPAN] * _TIMES + _PLUS).min(axis=1))
    return low


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, key, bands) of every row with an id: a digest of its set of shingles, and a bucket of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
            keys, low = [], np.empty((b.num_rows, BANDS * ROWS), np.uint64)
            for i, t in enumerate(b.column(1)):
                some = shingles(t.as_py() or b"", width)
                h = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), np.uint64, len(some)))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                low[i] = minima(h)
            rows = low.reshape(-1, BANDS, ROWS)
            bucket = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (b.num_rows, 1))
            for k in range(ROWS):
                bucket = (bucket ^ rows[:, :, k]) * _MIX
                bucket ^= bucket >> np.uint64(29)
            ends = pa.array(np.arange(0, b.num_rows * BANDS + 1, BANDS, dtype=np.int32))
            bands = pa.ListArray.from_arrays(ends, pa.array(bucket.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), bands], ["doc_id", "key", "bands"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, key binary, bands array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, sh): the sorted 64-bit hashes of each row's set of shingles, as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
            out = []
            for t in b.column(1):
                some = shingles(t.as_py() or b"", width)
                out.append(np.sort(np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), np.uint64, len(some))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "sh"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, sh binary")


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                near = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    if len(small) < similar * len(large) - 1:
                        near.append(False)
                        continue
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    near.append(both / (len(x) + len(y) - both) >= similar)
                keep = pa.array(near, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    first, second = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def connecting(ids: np.ndarray, comp: np.ndarray, outside: np.ndarray, inside: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Edges between similar rows of `outside` and `inside` that connect components, each only if it connects something new."""
    low = {c: c for c in comp.tolist()}

    def find(c):
        while low[c] != c:
            low[c] = low[low[c]]
            c = low[c]
        return c

    own = [sets[i] for i in inside.tolist()]
    size = np.array([len(x) for x in own], np.int64)
    kinds, number = np.unique(np.concatenate(own) if own else np.empty(0, np.uint64), return_inverse=True)
    order = np.argsort(number, kind="stable")
    member = np.repeat(np.arange(len(own)), size)[order]
    begin = np.searchsorted(number[order], np.arange(len(kinds) + 1))
    out = []
    for i in outside.tolist():
        x = sets[i]
        at = np.minimum(np.searchsorted(kinds, x), max(0, len(kinds) - 1))
        at = at[kinds[at] == x] if len(kinds) else at[:0]
        n = begin[at + 1] - begin[at]
        posts = member[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        both = np.bincount(posts, minlength=len(own))
        for k in np.flatnonzero(both / np.maximum(1, len(x) + size - both) >= similar).tolist():
            a, b = find(int(comp[i])), find(int(comp[inside[k]]))
            if a != b:
                low[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[inside[k]])))
    return out


def _apart(left: DataFrame, sets: DataFrame, similar: float, block: int) -> DataFrame:
    """Edges (a, b) between components that share a bucket. `left`: (bucket, node, c) of the buckets that hold several components c."""
    hub = left.groupBy("bucket").agg(F.min("node").alias("hub"))
    of = written(components(left.join(written(hub, "hubs"), "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))), "clusters")
    nodes = left.select("node", "c").distinct()
    nodes = nodes.join(of, "node", "left").select("node", "c", F.coalesce("root", "node").alias("cluster"))
    nodes = written(nodes.join(sets.select(F.col("id").alias("node"), F.octet_length("sh").alias("size")), "node"), "nodes")
    by_comp = written(nodes.groupBy("cluster", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "sizes")
    sizes = by_comp.groupBy("cluster").agg(F.max(F.struct("n", "size", "c")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    parts = lambda n, size: F.ceil(F.greatest(n / block, size / (block << 13))).cast("long")
    sizes = sizes.select("cluster", F.col("main.c").alias("main"), parts(F.col("n"), F.col("size")).alias("tb"), F.greatest(F.lit(1), parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))).alias("ta"))
    dealt = nodes.join(written(sizes, "sizes"), "cluster").withColumn("h", F.xxhash64("node"))
    until = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    outside = dealt.where("c <> main").select("cluster", F.pmod("h", F.col("ta")).alias("i"), F.explode(until(F.col("tb"))).alias("j"), F.lit(True).alias("outer"), "node", "c")
    inside = dealt.select("cluster", F.explode(until(F.col("ta"))).alias("i"), F.pmod("h", F.col("tb")).alias("j"), F.lit(False).alias("outer"), "node", "c")
    rows = outside.union(inside).join(sets.select(F.col("id").alias("node"), "sh"), "node")

    def compare(t: pa.Table) -> pa.Table:
        outer = t.column("outer").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("sh")]
        got = connecting(t.column("node").to_numpy(), t.column("c").to_numpy(), np.flatnonzero(outer), np.flatnonzero(~outer), sets, similar)
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: float = SIMILAR, block: int = BLOCK, given: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of every row with an id: the smallest id that is reachable over near copies.

    `given`: pairs of ids (a, b) that another method took for near copies; they
    are verified like the candidates found here.

    Equal sets of shingles are folded first. Rows that repeat an id should
    repeat its text; else each of its texts has a row in the result. A null text
    is empty. An empty table gives an empty result.
    """
    sig = written(signatures(docs, id_col, text_col, width), "signatures")
    folded = written(sig.groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("low")).select("key", F.col("low.doc_id").alias("node"), "low.bands"), "sets")
    wide = folded.select("node", F.explode("bands").alias("bucket"))
    shared = written(wide.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(wide.join(shared, "bucket"), "members")
    # The most central member of a bucket shares the most buckets with the most others.
    weight = written(members.groupBy("node").agg(F.sum("n").alias("w")), "weights")
    pivots = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("w", F.bitwise_not("node").alias("down"))).alias("best"))
    pivots = written(pivots.select("bucket", F.bitwise_not("best.down").alias("pivot")), "pivots")
    star = written(members.join(pivots, "bucket").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    of = weight.select("node")
    if given is not None:
        node_of = sig.select("doc_id", "key").join(folded.select("key", "node"), "key")
        first, second = node_of.select(F.col("doc_id").alias("a"), F.col("node").alias("x")), node_of.select(F.col("doc_id").alias("b"), F.col("node").alias("y"))
        star = written(star.union(given.join(first, "a").join(second, "b").where("x <> y").select("x", "y")).distinct(), "pairs")
        of = written(of.union(star.select("a")).union(star.select("b")).distinct(), "involved")
    (involved,) = free_names(docs, "involved")
    some = docs.join(of.select(F.col("node").alias(involved)), F.col(id_col).cast("long") == F.col(involved), "left_semi")
    sets = written(shingle_sets(some, id_col, text_col, width).dropDuplicates(), "shingles")

    links = written(_verified(star, sets, similar), "links")
    superseded(star, pivots, weight, shared)
    root = components(links)
    named = written(members.join(root, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("c")), "named")
    mixed = written(named.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket"), "mixed")
    left = written(named.join(mixed, "bucket", "left_semi"), "apart")
    superseded(members, named)
    more = written(_apart(left, sets, similar, block), "links")
    if not more.isEmpty():
        root = components(links.union(more))
    superseded(left, sets)
    named = folded.join(root, "node", "left").select("key", F.coalesce("root", "node").alias("component_id"))
    return sig.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: float = SIMILAR, given: DataFrame | None = None) -> DataFrame:
    """The documents of `docs` that have the smallest id of their group, with all their columns; rows without an id stay.

    An id that repeats goes if one of its texts has a copy with a smaller id.
    Columns may have any names.
    """
    (name,) = free_names(docs, "gone")
    gone = groups(docs, id_col, text_col, width, similar, given=given).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(written(gone, "gone"), F.col(id_col) == F.col(name), "left_anti")
