"""Mixture-controlled packing of documents into windows of fixed size.

Deficit round-robin over source queues. In each round a queue earns its share
of one window; it serves whole grains of tokens once it has earned them and
carries the rest of its deficit into the next round. The served stream, round
after round and queue after queue, is cut into windows, so every window is
full except the last one and holds the target proportions to within a grain
for each queue. A queue that runs dry leaves its share to the others in
proportion to their weights.

What a queue has served after any round is a closed formula of the queues'
totals, so partitions need no order among them: each places its own rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, written
from .tokens import token_table

WINDOW, GRAIN = 2048, 256
#: Chunks that a worker keeps; fewer than elsewhere, since packing shares workers with what runs before it.
KEPT = 300_000
#: Most queues: their totals are sent to every task, five numbers each (2.6 MB).
MAX_QUEUES = 1 << 16


class Schedule:
    """Rounds of the queues. `totals`: tokens of each queue; `weights`: target proportions, by default the totals.

    All active queues share one clock: queue q has earned weight x clock tokens,
    and runs dry at clock total / weight. A round moves the clock on by as much
    as lets the queues that are active then earn one window together.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW, grain: int = GRAIN) -> None:
        self.totals = np.array(totals, np.int64)
        self.weights = w = np.array(totals if weights is None else weights, np.float64)
        if len(w) and not ((w > 0) & np.isfinite(w)).all():
            raise ValueError("weights have to be positive")
        self.grain = grain
        dry = self.totals / w
        order = np.argsort(dry, kind="stable")
        clock = dry[order]
        done, rest = np.cumsum(self.totals[order]), w.sum() - np.cumsum(w[order])
        earned = done + clock * np.maximum(rest, 0)  # by all queues together
        rounds = np.maximum.accumulate(earned / window) if len(w) else earned
        # The clock after any number of rounds lies between these points.
        self.rounds, self.clock = np.r_[0.0, rounds], np.r_[0.0, clock]
        # After these rounds a queue has served all it has.
        self.last = np.empty(len(w), np.int64)
        self.last[order] = np.maximum(1, np.ceil(rounds * (1 - 1e-12))).astype(np.int64)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has served after each of these rounds: (rounds, queues)."""
        earned = np.interp(rounds, self.rounds, self.clock)[:, None] * self.weights
        whole = np.minimum((earned / self.grain).astype(np.int64) * self.grain, self.totals)
        return np.where(rounds[:, None] >= self.last, self.totals, whole)

    def _served_by(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        earned = np.interp(rounds, self.rounds, self.clock) * self.weights[queue]
        whole = np.minimum((earned / self.grain).astype(np.int64) * self.grain, self.totals[queue])
        return np.where(rounds >= self.last[queue], self.totals[queue], whole)

    def round_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The round that serves token `at` of each queue (at < its total): an exact search over served()."""
        low, high = np.zeros(len(at), np.int64), self.last[queue].copy()
        while (open_ := high - low > 1).any():
            mid = np.where(open_, (low + high) // 2, high)
            over = self._served_by(queue, mid) > at
            high, low = np.where(over, mid, high), np.where(over, low, np.where(open_, mid, low))
        return high

    def place(self, queue: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Round of each token `at` of its queue, and its position in the stream of all queues."""
        r = self.round_of(queue, at)
        rounds, which = np.unique(r, return_inverse=True)
        out = np.empty(len(at), np.int64)
        step = max(1, (1 << 22) // max(1, len(self.totals)))  # 32 MB for each array
        by_round = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[by_round], np.arange(0, len(rounds) + step, step))
        for s, lo, hi in zip(range(0, len(rounds), step), bounds, bounds[1:], strict=False):
            before, after = self.served(rounds[s : s + step] - 1), self.served(rounds[s : s + step])
            lead = before.sum(axis=1)[:, None] + np.cumsum(after - before, axis=1) - after
            some = by_round[lo:hi]
            out[some] = lead[which[some] - s, queue[some]] + at[some]
        return r, out


def _cut(start: np.ndarray, end: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals cut at the multiples of step: index of the interval, start and end of each part."""
    n = (end - 1) // step - start // step + 1
    which = np.repeat(np.arange(len(start)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    cell = start[which] // step + k
    return which, np.maximum(start[which], cell * step), np.minimum(end[which], (cell + 1) * step)


def place_pieces(schedule: Schedule, queue: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of rows that lie at `start` of their queues: row, offset in the row, length, position in the stream."""
    row, s, e = _cut(start, start + n, schedule.grain)
    rounds, pos = schedule.place(queue[row], s)
    # Grains of one row that follow each other in the stream are one piece until a window ends.
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + (e - s)[:-1])
    first = np.flatnonzero(new)
    size = np.add.reduceat(e - s, first) if len(first) else np.zeros(0, np.int64)
    row, off, pos = row[first], s[first] - start[row[first]], pos[first]
    part, ps, pe = _cut(pos, pos + size, window)
    return row[part], off[part] + ps - pos[part], pe - ps, ps


def queue_of(docs: DataFrame, source_col: str, weighted: bool) -> Column:
    """The name of a row's queue: its source; null is a source of its own.

    Beyond MAX_QUEUES sources those of a hash bucket share a queue. Targets by
    source would be lost there, so weights are refused.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    if docs.select(source_col).distinct().limit(MAX_QUEUES + 1).count() <= MAX_QUEUES:
        return name
    if weighted:
        raise ValueError(f"weights need at most {MAX_QUEUES} sources")
    return F.pmod(F.xxhash64(name), F.lit(MAX_QUEUES)).cast("string")


def pieces(docs: DataFrame, tokenizer: str, weights: dict[str, float] | None = None, window: int = WINDOW, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the piece's ids.

    Every document ends with id 1; a null text is empty and gives that id
    alone. Rows that repeat an id, or have none, are documents of their own.
    `weights` gives the target proportions by source (others get the smallest of
    them; the null source's name is the empty string); by default they are the
    sources' shares of all tokens, so that all queues run dry together. Other
    columns are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    (name,) = free_names(docs, "queue")
    queued = docs.withColumn(name, queue_of(docs, source_col, bool(weights)))
    tokens = written(token_table(queued, tokenizer, False, id_col, text_col, name, KEPT), "tokens")
    parts = written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "parts")
    totals = sorted((r["queue"], r["n"]) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # MAX_QUEUES rows at most
    low = min(weights.values()) if weights else 0
    schedule = Schedule([n for _, n in totals], [weights.get(q[1:], low) for q, _ in totals] if weights else None, window, grain)
    number = {q: i for i, (q, _) in enumerate(totals)}
    held = spark.sparkContext.broadcast((schedule, number))
    base = written(parts.select("queue", "part", (F.sum("n").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base")), "base")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, number = held.value
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                n = b.column(2).to_numpy(zero_copy_only=False)
                start = b.column(4).to_numpy(zero_copy_only=False) + b.column(5).to_numpy(zero_copy_only=False)
                queue = np.array([number[q] for q in b.column(3).to_pylist()], np.int64)
                row, off, size, pos = place_pieces(schedule, queue, start, n, window)
                wide = [memoryview(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in b.column(1).to_pylist()]
                cut = [wide[r][4 * o : 4 * (o + k)] for r, o, k in zip(row.tolist(), off.tolist(), size.tolist(), strict=True)]
                cols = [b.column(0).take(pa.array(row)), pa.array(off), pa.array(size), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[row]), pa.array(pos // window), pa.array(pos % window)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(x) for x in cut], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = tokens.join(base, ["queue", "part"]).select("doc_id", "ids", "n", "queue", "at", "base")
    return rows.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def sequences(pieces_with_ids: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n, ids array<int>): each window's ids, filled up to `window` with pad_id unless n is a power of two."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a window's pieces hold `window` ids at most
    one = pieces_with_ids.groupBy("sequence_id").agg(ordered.alias("p"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int32) for p in b.column(1).to_pylist()]
            full = [x if len(x) & len(x) - 1 == 0 else np.pad(x, (0, window - len(x)), constant_values=pad_id) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array(full, pa.list_(pa.int32()))], ["sequence_id", "n", "ids"])

    return one.mapInArrow(join, "sequence_id long, n int, ids array<int>")
