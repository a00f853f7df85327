"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine t or more lie within the squared distance 2 - 2t.
After a fixed random rotation, which spreads distances evenly, the coordinates
are split into blocks of BLOCK dimensions; a close pair must be within its
proportional share of the squared distance in at least one block. That range
join runs over strips of one radius on the first coordinates of the block; rows
in neighbouring strips are compared over the block by matrix products, and what
these leave is computed exactly. A pair is taken up in the first block that
admits it, its whole distance decides, and pairs within rounding of the
threshold are verified on the vectors as given.

Rows of one label go to one task as long as they are few. Larger labels are
cut into tiles by a hash, written once, and every pair of tiles is a task that
reads its two tiles from their files: no row is shuffled more than once,
however large its label is. Equal vectors, found by a 128-bit digest, are
compared as one.

Links leave a task as counts for each vector and as edges that connect what is
linked, never pair by pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans.steps import remove

from . import warc
from .common import components, free_names, new_path, superseded, written

BLOCK, SEED, SLACK = 8, 11, 1e-5
#: Squared distances this near to the limit are verified with the vectors as given.
UNSURE = 1e-6
#: Rows of a tile; larger labels are cut.
SPLIT = 1 << 16
#: Pairs that a matrix product gives at a time, and what its rounding can amount to.
CHUNK, ROUNDING = 1 << 20, 4e-6
#: Coordinates of a block that are cut into strips, at most; rows that a strip on all of them should have.
STRIPS, ROWS = 3, 64
#: Cells are so many radii wide.
WIDE = 4

#: Roles of a row within a group: compared with others, compared and found, found by others only.
VISITOR, BOTH, HOME = 0, 1, 2


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, threshold: float) -> list[tuple[int, int, float]]:
    """Begin, end and budget of each block."""
    cut = [(s, min(dims, s + BLOCK)) for s in range(0, dims, BLOCK)]
    return [(s, e, (2 - 2 * threshold) * (e - s) / dims + SLACK) for s, e in cut]


def _matrix(col: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # first, so that no square overflows or vanishes
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def visits(x: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells on the columns of x that rows are in or near, for callers that cut a group themselves: (row, whether at home, cell numbers)."""
    grid = x / (WIDE * radius)
    home = np.floor(grid).astype(np.int64)
    low, high = (np.floor(grid + d / WIDE).astype(np.int64) for d in (-1, 1))
    for which in np.ndindex(*(2,) * x.shape[1]):
        w = np.array(which, bool)
        cell = np.where(w, high, low)
        at = np.flatnonzero((~w | (high > low)).all(axis=1))
        yield at, (cell[at] == home[at]).all(axis=1), cell[at]


def near_pairs(x: np.ndarray, budget: float, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row marked in `one`, row marked in `two`) with a squared distance up to the budget, each once; some just beyond it come too."""
    first, second = np.flatnonzero(one), np.flatnonzero(two)
    if not len(first) or not len(second):
        return
    radius = np.sqrt(budget)
    width = min(STRIPS, x.shape[1], int(np.log(max(1, len(second) / ROWS)) / np.log(8)))
    # One number for the strips of a row, with room for the neighbours on every coordinate.
    code = np.floor(x[:, :width].astype(np.float64) / radius).astype(np.int64)
    code -= code.min(axis=0) - 1 if width else 0
    times = np.ones(width, np.int64)
    for k in range(width - 2, -1, -1):
        times[k] = times[k + 1] * (code[:, k + 1].max() + 2)
    key = code @ times if width else np.zeros(len(x), np.int64)
    first, second = first[np.argsort(key[first], kind="stable")], second[np.argsort(key[second], kind="stable")]
    cells, starts = np.unique(key[first], return_index=True)
    ends, strips = np.append(starts[1:], len(first)), key[second]
    steps = [int(np.dot(d, times[:-1])) for d in product((-1, 0, 1), repeat=max(0, width - 1))]
    reach = 1 if width else 0
    low = [np.searchsorted(strips, cells + d - reach) for d in steps]
    high = [np.searchsorted(strips, cells + d + reach, "right") for d in steps]
    x = np.ascontiguousarray(x, np.float32)
    norm = (x * x).sum(axis=1)[:, None]
    left = np.hstack([x, norm, np.ones_like(norm)])
    right = np.hstack([-2 * x, np.ones_like(norm), norm])
    found, held = [], 0
    for c in range(len(cells)):
        b = np.concatenate([second[lo[c] : hi[c]] for lo, hi in zip(low, high, strict=True)])
        for t in range(0, len(b), CHUNK >> 8):
            some = b[t : t + (CHUNK >> 8)]
            other, step = right[some].T, max(1, CHUNK // len(some))
            for r in range(starts[c], ends[c], step):
                a = first[r : min(ends[c], r + step)]
                at = np.flatnonzero(left[a] @ other <= budget + ROUNDING)  # one dimension is far faster to look through
                if len(at):
                    found.append((a[at // len(some)], some[at % len(some)]))
                    held += len(at)
                if held >= CHUNK >> 4:
                    yield tuple(map(np.concatenate, zip(*found, strict=True)))
                    found, held = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found, strict=True)))


class Linked:
    """What a group has found: linked copies of each row, a label of each connected part, pairs that are not sure; how many pairs were computed exactly."""

    def __init__(self, n: int) -> None:
        self.degree, self.label, self.unsure, self.compared = np.zeros(n, np.int64), np.arange(n), [], 0

    def add(self, i: np.ndarray, j: np.ndarray, copies: np.ndarray) -> None:
        n = len(self.degree)
        # Sums of integers, exact in doubles.
        self.degree += (np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)
        while len(i):
            a, b = self.label[i], self.label[j]
            if (a == b).all():
                break
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def compare(ids: np.ndarray, y: np.ndarray, copies: np.ndarray, role: np.ndarray, block: int, threshold: float) -> Linked:
    """Links between rows of one group, of one block or (-1) of all.

    A pair belongs to the row with the smaller id, which has to be at home, and
    to the first block within whose budget it is.
    """
    out, limit = Linked(len(ids)), 2 - 2 * threshold
    each = blocks(y.shape[1], threshold)

    def apart(i: np.ndarray, j: np.ndarray, s: int, e: int) -> np.ndarray:
        d = np.zeros(len(i))
        for k in range(s, e):  # in this order always, so that every task gets the same sum
            t = y[i, k].astype(np.float64) - y[j, k]
            d += t * t
        return d

    for b in range(len(each)) if block < 0 else [block]:
        s, e, budget = each[b]
        for i, j in near_pairs(y[:, s:e], budget, role >= BOTH, role <= BOTH):
            mine = ids[i] < ids[j]
            i, j = i[mine], j[mine]
            out.compared += len(i)
            near = apart(i, j, s, e) <= budget
            i, j = i[near], j[near]
            for s2, e2, budget2 in each[:b]:
                rest = apart(i, j, s2, e2) > budget2
                i, j = i[rest], j[rest]
            if len(i):
                d = apart(i, j, 0, y.shape[1])
                unsure = np.abs(d - limit) <= UNSURE
                out.unsure += zip(ids[i[unsure]].tolist(), ids[j[unsure]].tolist(), strict=True)
                sure = d < limit - UNSURE
                out.add(i[sure], j[sure], copies)
    return out


COUNT, EDGE, PAIR = 0, 1, 2
FOUND = "kind int, a long, b long"


def _links(ids: np.ndarray, got: Linked) -> pa.Table:
    """COUNT rows say that a has b more links, EDGE rows connect what is linked, PAIR rows, by position in `got`, are to be verified."""
    some, part = np.flatnonzero(got.degree), np.flatnonzero(got.label != np.arange(len(ids)))
    pairs = ids[np.array(got.unsure, np.int64).reshape(-1, 2)]
    kind = np.repeat(np.array([COUNT, EDGE, PAIR], np.int32), [len(some), len(part), len(pairs)])
    a, b = np.concatenate([ids[some], ids[part], pairs[:, 0]]), np.concatenate([got.degree[some], ids[got.label[part]], pairs[:, 1]])
    return pa.table({"kind": kind, "a": a, "b": b})


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32) if size else np.zeros(len(rows) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _plain(kind: str):
    """(vec_id, label, dims, digest, x) of rows (vec_id, label, v) that can link; x by kind: nothing, the rotated unit vector or the doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(s, 1024) for whole in batches for s in range(0, whole.num_rows, 1024)):
            size = np.array(b.column(2).value_lengths().fill_null(0))
            flat, begin = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size) - size
            for k in np.unique(size[size > 0]):
                at = np.flatnonzero(size == k)
                v = flat[begin[at][:, None] + np.arange(k)] + 0.0
                usable = np.isfinite(v).all(axis=1) & v.any(axis=1)
                at, v = at[usable], np.ascontiguousarray(v[usable], "<f8")
                if not len(at):
                    continue
                digest = [hashlib.blake2b(r, digest_size=16).digest() for r in v]
                cols = [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.full(len(at), k, np.int32)), pa.array(digest, pa.binary())]
                names = ["vec_id", "label", "dims", "digest"]
                if kind:
                    cols.append(_binary(v if kind == "doubles" else (_unit(v) @ rotation(int(k))).astype("<f4")))
                    names.append("x")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _halves(col: pa.Array) -> np.ndarray:
    return _matrix(col, "<i8").reshape(len(col), 2)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, id, n, y) of each vector of rows (part, digest, vec_id, y) that come sorted by these; ids that repeat count once."""
    held = last = None

    def row(b: pa.RecordBatch, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        c = b.take(pa.array(at))
        return pa.RecordBatch.from_arrays([c.column(0), c.column(2), pa.array(n.astype(np.int64)), c.column(3)], ["part", "id", "n", "y"])

    for b in batches:
        if not b.num_rows:
            continue
        key = np.column_stack([b.column(0).to_numpy(), _halves(b.column(1)), b.column(2).to_numpy()])
        before = np.concatenate([key[:1] if last is None else last, key[:-1]])
        new = (key[:, :3] != before[:, :3]).any(axis=1)
        fresh = new | (key[:, 3] != before[:, 3])
        if last is None:
            new[0] = fresh[0] = True
        starts, last = np.flatnonzero(new), key[-1:]
        head = int(fresh[: starts[0] if len(starts) else None].sum())
        if held:
            held = (held[0], held[1] + head)
        if len(starts):
            if held:
                yield row(held[0], np.array([0]), np.array([held[1]]))
            n = np.add.reduceat(fresh.astype(np.int64), starts)
            if len(starts) > 1:
                yield row(b, starts[:-1], n[:-1])
            held = (b.slice(int(starts[-1]), 1), int(n[-1]))
    if held:
        yield row(held[0], np.array([0]), np.array([held[1]]))


def _tile(path: str, part: int) -> pa.Table:
    """The rows of a part, from its files."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        store, root = fs.LocalFileSystem(), re.sub("^(file:)?/*", "/", path)
    else:
        store, root = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.ParquetFile(store.open_input_file(f)).read(columns=["id", "n", "y"]) for f in sorted(files)]
    return pa.concat_tables(tables) if tables else pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "y": pa.array([], pa.binary())})


def _across(one: pa.Table, two: pa.Table | None, threshold: float) -> pa.Table:
    """Links between two tiles, or within one."""
    both = one if two is None else pa.concat_tables([one, two])
    if not both.num_rows:
        return _links(np.empty(0, np.int64), Linked(0))
    role = np.full(both.num_rows, BOTH)
    if two is not None:
        role[: one.num_rows], role[one.num_rows :] = HOME, VISITOR
    # Positions are the ids, so that the first tile has the smaller ones.
    got = compare(np.arange(both.num_rows), _matrix(both.column("y"), "<f4"), both.column("n").to_numpy(), role, -1, threshold)
    return _links(both.column("id").to_numpy(), got)


def _found(rows: DataFrame, sizes: DataFrame, threshold: float, split: int) -> DataFrame:
    """(kind, a, b) as in _links. `rows`: (vec_id, label, dims, digest, y), `sizes`: (label, dims, n, classes)."""
    spark = rows.sparkSession

    def whole(t: pa.Table) -> pa.Table:
        key, ids = _halves(t.column("digest")), t.column("vec_id").to_numpy()
        order = np.lexsort((ids, key[:, 1], key[:, 0]))
        part = pa.array(np.zeros(len(ids), np.int64))
        t = pa.Table.from_arrays([part, *(t.column(c) for c in ("digest", "vec_id", "y"))], ["part", "digest", "vec_id", "y"]).take(pa.array(order))
        return _across(pa.Table.from_batches(_fold(iter(t.combine_chunks().to_batches()))), None, threshold)

    large = sizes.where(F.col("n") > split)
    if large.isEmpty():
        return written(rows.groupBy("label", "dims").applyInArrow(whole, FOUND), "found")
    own = ["label", "dims"]
    few = written(rows.join(large, own, "left_anti").groupBy(*own).applyInArrow(whole, FOUND), "found")

    # One row for at least `split` rows of input.
    tiles, pairs, first = [], [], 0
    for r in large.collect():
        k = -(-r.classes // split)
        tiles.append((r.label, r.dims, first, k))
        pairs += [(first + i, first + j) for i in range(k) for j in range(i, k)]
        first += k
    cut = spark.createDataFrame(tiles, f"label {dict(rows.dtypes)['label']}, dims int, first long, k long")
    dealt = rows.join(F.broadcast(cut), own).select((F.col("first") + F.pmod(F.xxhash64("digest"), F.col("k"))).alias("part"), "digest", "vec_id", "y")
    path = new_path(spark, "tiles")
    dealt.repartition("part").sortWithinPartitions("part", "digest", "vec_id").mapInArrow(_fold, "part long, id long, n long, y binary").write.partitionBy("part").parquet(path)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from _across(_tile(path, i), None if i == j else _tile(path, j), threshold).to_batches()

    def shuffled(t: pa.Table) -> pa.Table:
        one, two = (t.filter(pa.array(t.column("home").to_numpy(zero_copy_only=False) == h)) for h in (True, False))
        return _across(one.select(["id", "n", "y"]), two.select(["id", "n", "y"]) if two.num_rows else None, threshold)

    todo = spark.createDataFrame(pairs, "i long, j long")
    scheme = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme in warc.RANGED:
        many = todo.repartition(min(len(pairs), warc.MAX_TASKS)).mapInArrow(tasks, FOUND)
    else:  # tasks cannot open the files: Spark brings each tile to its pairs
        t = spark.read.schema("id long, n long, y binary, part long").parquet(path)
        homes = t.join(todo, t.part == todo.i).select("i", "j", F.lit(True).alias("home"), "id", "n", "y")
        others = t.join(todo, (t.part == todo.j) & (todo.i < todo.j)).select("i", "j", F.lit(False).alias("home"), "id", "n", "y")
        many = homes.union(others).groupBy("i", "j").applyInArrow(shuffled, FOUND)
    many = written(many, "found")
    remove(spark, path)
    return few.union(many)


def _verify(threshold: float):
    """The pairs of rows (a, b, v1, v2) whose cosine is the threshold at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                part = whole.slice(s, 4096)
                size = np.array([len(v) for v in part.column(2).to_pylist()])
                for n in np.unique(size):
                    r = part.filter(pa.array(size == n))
                    x, y = _matrix(r.column(2), "<f8"), _matrix(r.column(3), "<f8")
                    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                    cos = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(cos >= threshold)) for c in r.columns[:2]], ["a", "b"])

    return run


def groups(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", split: int = SPLIT) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Only rows with the same label, not null, are compared. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing,
    and so do rows without an id (their component_id is null); vectors of
    different lengths never link. Equal vectors are compared as one and count
    as linked with each other. Rows that repeat an id stand for one vector, the
    one with the smallest label, then of the smallest length and digest. Other
    columns are left out. An empty table gives an empty result.

    Whole vectors are shuffled and written once, as rotated single floats; what
    else is kept are ids and digests.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold has to be a positive cosine")
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kinds = f"vec_id long, label {dict(rows.dtypes)['label']}, dims int, digest binary"
    some = rows.where("vec_id is not null and label is not null and v is not null")
    own = ["label", "dims", "digest"]
    best = F.min(F.struct(*own))
    every = written(some.mapInArrow(_plain(""), kinds).groupBy("vec_id").agg(best.alias("best"), (best != F.max(F.struct(*own))).alias("several")), "vectors")
    usable = every.select("vec_id", *(f"best.{c}" for c in own))
    several = written(every.where("several").select("vec_id", "best"), "several")
    unique = several.isEmpty()

    def chosen(kind: str) -> DataFrame:
        got = some.mapInArrow(_plain(kind), f"{kinds}, x binary")
        if unique:
            return got
        return got.join(several, "vec_id", "left").where(F.col("best").isNull() | (F.col("best") == F.struct(*own))).drop("best")

    classes = written(usable.groupBy(*own).agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    sizes = written(classes.groupBy("label", "dims").agg(F.sum("n").alias("n"), F.count("*").alias("classes")), "sizes")
    found = _found(chosen("rotated").withColumnRenamed("x", "y"), sizes, threshold, split)

    unsure = written(found.where(F.col("kind") == PAIR).select("a", "b").distinct(), "unsure")
    ids = written(unsure.select(F.col("a").alias("vec_id")).union(unsure.select("b")).distinct(), "ids")
    vector = chosen("doubles").join(ids, "vec_id", "left_semi").select("vec_id", "x").dropDuplicates(["vec_id"])
    vector = written(vector if not ids.isEmpty() else vector.limit(0), "doubles")
    sure = unsure.join(vector.toDF("a", "v1"), "a").join(vector.toDF("b", "v2"), "b").select("a", "b", "v1", "v2")
    sure = written(sure.mapInArrow(_verify(threshold), "a long, b long"), "verified")
    many = classes.select("id", F.col("n").alias("k"))
    more = sure.join(many, sure.b == many.id).select("a", "k").union(sure.join(many, sure.a == many.id).select("b", "k"))
    degree = found.where(F.col("kind") == COUNT).select("a", F.col("b").alias("k")).union(more).groupBy("a").agg(F.sum("k").alias("more"))
    root = components(found.where(F.col("kind") == EDGE).select("a", "b").union(sure))
    known = classes.join(degree, F.col("id") == F.col("a"), "left").join(root, F.col("id") == F.col("node"), "left")
    known = known.select(*own, (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    mine = written(usable.join(written(known, "known"), own).select("vec_id", "n_links", "component_id"), "mine")
    superseded(every, vector)
    out = rows.select("vec_id").join(mine, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def dedup(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """The rows that have the smallest id of their group, with all their columns, whatever their names; rows without an id stay."""
    (name,) = free_names(vectors, "gone")
    gone = groups(vectors, threshold, id_col, vector_col, label_col).where("not kept").select(F.col("vec_id").alias(name)).distinct()
    return vectors.join(written(gone, "gone"), F.col(id_col) == F.col(name), "left_anti")
