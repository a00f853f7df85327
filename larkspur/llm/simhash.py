"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints are 64-bit majorities over the XXH64 of word shingles. To link
all fingerprints within RADIUS bits, every bit position gets a non-zero vector
of RADIUS + 1 bits; each non-zero vector u gives a mask of the positions whose
vector has odd parity with u. Any RADIUS differing positions leave some u
orthogonal to all of them, so every close pair agrees under some mask: 15
tables find all pairs at 3 bits (Pagh 2016). A bucket with many members is
split again, by masks of the same structure over the bits that its mask left
free; after three levels at most 8 bits are free, so a bucket has at most 256
members and no bucket is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dedup
from .common import components, free_names, superseded, written

RADIUS, SEED = 3, 42
#: Largest bucket whose members are compared directly; 2**8 ends the recursion.
BUCKET = 256
#: Words of a text that are hashed at a time.
SPAN = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), 0
    for start in range(0, max(1, len(words) - width + 1), SPAN):
        part = words[start : start + SPAN + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; a null text is an empty one, with fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _split(positions: list[int]) -> list[int]:
    """Masks over these bit positions that cover every RADIUS of them."""
    vector = {p: j % 15 + 1 for j, p in enumerate(positions)}
    return [sum(1 << p for p in positions if bin(u & vector[p]).count("1") % 2) for u in range(1, 16)]


def _masks() -> list[list[tuple[int, ...]]]:
    """All masks of each level, each with the masks that it was refined from."""
    levels = [[(m,) for m in _split(list(range(64)))]]
    for _ in range(2):
        levels.append([(*t, t[-1] | m) for t in levels[-1] for m in _split([p for p in range(64) if not t[-1] >> p & 1])])
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LEVELS = _masks()



def _span(fp: np.ndarray) -> np.ndarray:
    """Edges that connect just what is connected within a bucket: fewer than its members."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= RADIUS
    left, out = np.ones(len(fp), bool), []
    for i in range(len(fp)):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                x = todo.pop()
                new = np.flatnonzero(near[x] & left)
                left[new] = False
                todo.extend(new.tolist())
                out.extend((x, y) for y in new)
    return fp[np.array(out, np.int64).reshape(-1, 2)]


def _edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within the buckets of rows (bucket, fp) that come sorted by bucket; the last bucket of a batch waits for the next."""
    held = np.empty((2, 0), np.int64)

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        bucket, fp = rows[0], rows[1].view(np.uint64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, sizes = np.r_[0, cuts], np.diff(np.r_[0, cuts, len(bucket)])
        small = np.repeat(sizes <= 16, sizes)
        out = [np.empty((0, 2), np.uint64)]
        for d in range(1, 16):
            i = np.flatnonzero((bucket[d:] == bucket[:-d]) & small[d:])
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS]
            out.append(np.stack([fp[i], fp[i + d]], axis=1))
        out += [_span(fp[s : s + n]) for s, n in zip(starts, sizes, strict=True) if n > 16]
        a, b = np.unique(np.concatenate(out), axis=0).view(np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            cut = int(np.searchsorted(held[0], held[0, -1]))
            if cut:
                yield edges(held[:, :cut])
                held = held[:, cut:]
    if held.shape[1]:
        yield edges(held)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) pairs of distinct fingerprints at RADIUS bits or fewer that connect all that is linked.

    `fps` has one long column fp without repeats. No link is lost: within each
    bucket the edges span what is connected. Buckets beyond `bucket` members
    are found by counting first, and only their rows are split by finer masks.
    """
    if bucket < BUCKET:
        raise ValueError("a bucket of the last level can hold 256 members")
    rows, found = fps.withColumn("m", F.lit(-1)), None
    for level, masks in enumerate(LEVELS):
        own = F.array(*[F.lit(_signed(t[-1])) for t in masks])
        first = F.col("m") * 15 + (15 if level == 0 else 0)
        wide = rows.select("fp", F.explode(F.sequence(first, first + 14)).alias("m"))
        wide = wide.select("fp", "m", F.xxhash64("m", F.col("fp").bitwiseAND(F.element_at(own, F.col("m") + 1))).alias("bucket"))
        last = level == len(LEVELS) - 1
        big = None if last else written(wide.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("bucket"), "buckets")
        some = big is not None and not big.isEmpty()
        small = wide.join(big, "bucket", "left_anti") if some else wide
        part = small.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
        edges = part.mapInArrow(_edges_of, "a long, b long")
        found = edges if found is None else found.union(edges)
        if not some:
            break
        rows = wide.join(big, "bucket", "left_semi").select("fp", "m")
    return found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links).

    Equal fingerprints are linked. A row without an id is its own group, with
    a null component_id. Rows that repeat an id have a row each; other columns
    are left out. Texts may be of any length. An empty table gives an empty result.
    """
    docs_fp = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    known = docs_fp.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low"))
    known = written(known, "distinct")
    root = components(links(known.select("fp")))
    comp = known.join(root, known.fp == root.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    named = comp.join(low, "root").select("fp", "component_id")
    out = docs_fp.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(a, b) pairs of ids whose fingerprints are linked, which connect all that the fingerprints link."""
    fps = written(fingerprints(docs, id_col, text_col, width).where("doc_id is not null"), "fingerprints")
    low = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    same = fps.join(low, "fp").where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    near = written(links(low.select("fp")), "links").toDF("x", "y").distinct()
    first, second = low.toDF("x", "a"), low.toDF("y", "b")
    out = written(same.union(near.join(first, "x").join(second, "y").select("a", "b")), "candidates")
    superseded(fps, low)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """The documents of `docs` that have the smallest id of their group, with all their columns; rows without an id stay.

    Groups are those of fingerprints at RADIUS bits. With `similarity`, what the
    fingerprints link is verified by the Jaccard similarity of the sets of
    shingles; pairs at that similarity that differ in more bits, which masks over
    64 bits cannot reach, are added by near_dedup. Rows that repeat the id that stays all stay. Columns
    may have any names.
    """
    if similarity is not None:
        return near_dedup.dedup(docs, id_col, text_col, width, similarity, candidates(docs, id_col, text_col, width))
    (gone,) = free_names(docs, "gone")
    dropped = groups(docs, id_col, text_col, width).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(written(dropped, "gone"), F.col(id_col) == F.col(gone), "left_anti")
