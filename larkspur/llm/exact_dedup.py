"""Exact deduplication by two-pass Bloom filtering.

Pass 1 marks, for every text, a few cells of a saturating two-bit counter
array. Pass 2 looks every text up: a text whose cells were not all marked at
least twice is certainly unique and passes straight through; only the others
shuffle to be compared by their SHA-256.

One array serves MAX_CELLS / CELLS_PER_ROW rows. Beyond that the hashes, and
nothing else, are written by ranges of that many rows; each range has an array
of its own, one after the other, and the hashes that any of them suspects make
up the Bloom filter that rows are looked up in. Its size follows the texts that
do repeat, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, new_path, written

#: White space that the normal form of a text leaves out.
SPACE = " \t\n\x0b\x0c\r"
#: Cells that each text marks, and cells for each row of the input.
PROBES, CELLS_PER_ROW = 3, 16
#: Cells of one segment, the unit in which the parts of the filter are merged.
SEGMENT = 1 << 17
#: Largest filter: 2**29 cells, a bitmap of 64 MB at the driver and in each executor's worker.
MAX_CELLS = 1 << 29


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cells of each hash, one row a probe (double hashing over the 64 bits)."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    step = high | np.uint64(1)
    return np.stack([(low + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(PROBES)]).astype(np.int64)


def filter_cells(rows: int, max_cells: int = MAX_CELLS) -> int:
    return min(max_cells, max(SEGMENT, 1 << (max(rows, 1) * CELLS_PER_ROW - 1).bit_length()))


def _bitmap(hashes: DataFrame, cells: int, least: int) -> np.ndarray:
    """Packed bits of the cells that `least` rows marked, 1 or 2.

    Every task sends the cells that it marked, by segment, as once/twice lists;
    segments are merged by their number.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [_cells(b["h"].to_numpy(), cells).ravel() for b in batches]
        if not got:
            return
        pos, n = np.unique(np.concatenate(got), return_counts=True)
        seg = pos // SEGMENT
        cuts = np.flatnonzero(np.diff(seg, prepend=-1))
        for s, e in zip(cuts, [*cuts[1:], len(pos)], strict=True):
            off, many = (pos[s:e] % SEGMENT).astype("<u4"), n[s:e] > 1
            yield pd.DataFrame({"segment": [int(seg[s])], "once": [off[~many].tobytes()], "twice": [off[many].tobytes()]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(SEGMENT, np.uint8)
        for once, twice in zip(part["once"], part["twice"], strict=True):
            o = np.frombuffer(once, "<u4")
            n[o] = np.minimum(n[o] + 1, 2)
            n[np.frombuffer(twice, "<u4")] = 2
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "bits": [np.packbits(n >= least).tobytes()]})

    parts = hashes.mapInPandas(mark, "segment int, once binary, twice binary")
    merged = parts.groupBy("segment").applyInPandas(merge, "segment int, bits binary")
    bits = np.zeros(cells // 8, np.uint8)
    for r in merged.toLocalIterator():  # at most MAX_CELLS / 8 bytes in all
        bits[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def repeated_filter(hashes: DataFrame, max_cells: int = MAX_CELLS) -> np.ndarray:
    """Pass 1: packed bits of a filter that every hash passes which two or more rows have.

    `hashes` has one long column h.
    """
    spark, rows = hashes.sparkSession, hashes.count()
    ranges = 1
    while filter_cells(-(-rows // ranges), 1 << 62) > max_cells:
        ranges *= 2
    if ranges == 1:
        return _bitmap(hashes, filter_cells(rows, max_cells), 2)
    folder = new_path(spark, "ranges")
    bits = ranges.bit_length() - 1
    hashes.withColumn("r", F.shiftrightunsigned("h", 64 - bits)).write.partitionBy("r").parquet(folder)
    suspects = []
    for r in range(ranges):
        own = spark.read.schema("h long, r long").parquet(folder).where(F.col("r") == r).select("h")
        look = may_repeat(spark, _bitmap(own, max_cells, 2))
        suspects.append(written(own.where(look("h")).distinct(), "suspects"))
    every = reduce(DataFrame.union, suspects)
    return _bitmap(every, filter_cells(every.count(), max_cells), 1)


def may_repeat(spark, bits: np.ndarray):
    """Pass 2: a function of a hash column, false where the text is surely unique."""
    held = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def look(h: pd.Series) -> pd.Series:
        b = held.value
        pos = _cells(h.to_numpy(), len(b) * 8)
        return pd.Series(((b[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(axis=0))

    return look


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. The longest original text of a group stays,
    then the smallest id; a null id loses every tie. Rows that repeat an id of
    the row that stays are all marked kept. Other columns are left out. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n"), F.unhex(F.sha2(normal(F.col(text_col)), 256)).alias("sha"))
    keys = written(keys.withColumn("h", F.xxhash64("sha")), "keys")
    look = may_repeat(docs.sparkSession, repeated_filter(keys.select("h"), max_cells))
    keys = keys.withColumn("again", look("h"))
    alone = keys.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    some = keys.where("again")
    # ~id orders ids downwards, without overflow.
    best = some.groupBy("sha").agg(F.max(F.struct("n", F.bitwise_not("doc_id").alias("down"))).alias("best"), F.count("*").alias("group_size"))
    # Written, so that the join has exchanges of its own and a very large group can be split.
    shared = some.join(written(best, "groups"), "sha").select("doc_id", F.bitwise_not("best.down").alias("keep_id"), "group_size", "sha")
    return alone.union(shared).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """Just one row of each group of equal texts, with all its columns; which one, see decide().

    Rows that repeat an id and text are ordered by a hash of their columns.
    Rows that the filter clears never shuffle; of the others every task sends one
    row a group. Columns may have any names.
    """
    h, again, sha, order, best = free_names(docs, "h", "again", "sha", "order", "best")
    hashed = docs.withColumn(h, F.xxhash64(normal(F.col(text_col))))
    look = may_repeat(docs.sparkSession, repeated_filter(hashed.select(F.col(h).alias("h")), max_cells))
    flagged = hashed.withColumn(again, look(h))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rank = F.struct(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.bitwise_not(F.col(id_col)), F.xxhash64(*plain))
    some = flagged.where(F.col(again)).select(F.sha2(normal(F.col(text_col)), 256).alias(sha), rank.alias(order), whole.alias(best))
    stay = some.groupBy(sha).agg(F.max_by(best, order).alias(best)).select(f"{best}.*")
    return flagged.where(~F.col(again)).select(*[F.col(f"`{c}`") for c in docs.columns]).union(stay)
