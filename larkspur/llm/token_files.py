"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank in the corpus (0 the most frequent). Four ranks
share a control byte of two bits each, the length of a rank in bytes less one;
the ranks' bytes, little-endian, follow in an area of their own (the Stream
VByte layout of Lemire et al., 2017). A file is a row of blocks:

    b"LKVB", u4 part, u4 documents, u4 control bytes, u4 data bytes,
    u8 ids in the part before the block, i8 x documents doc_id,
    u4 x documents ids of each, control bytes, data bytes, b"\\n"

Each document's ranks are filled up with rank 0 to a multiple of four. A null
doc_id is written as the smallest i8. Numbers are little-endian. Parts ascend
by doc_id, and so do documents in a part. `ranks` holds the id of each rank.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import superseded, written
from .tokens import token_table

MAGIC, HEAD, NO_ID = b"LKVB", "<4sIIIIQ", -(1 << 63)
#: Ids of a file and of a block, about; a document is never cut.
FILE_IDS, BLOCK_IDS = 1 << 23, 1 << 18

#: By control byte: the four lengths, their sum.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
TOTAL = LENGTHS.sum(axis=1, dtype=np.int64)


def encode(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of ranks, whose number is a multiple of four."""
    r = ranks.astype(np.uint32)
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    q = extra.reshape(-1, 4)
    control = (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8)
    end = np.cumsum(extra, dtype=np.int64) + np.arange(1, len(r) + 1)
    at = end - extra - 1
    data = np.empty(int(end[-1]) if len(r) else 0, np.uint8)
    data[at] = r & 0xFF
    for k in range(1, 4):
        some = np.flatnonzero(extra >= k)
        data[at[some] + k] = r[some] >> 8 * k & 0xFF
    return control, data


def decode(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ranks from control and data bytes, by looking lengths up in a table."""
    lengths = LENGTHS[control].ravel()
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        some = np.flatnonzero(lengths > k)
        if not len(some):
            break
        out[some] |= data[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def ranks_of(tokens: DataFrame) -> DataFrame:
    """(id, count, rank) of every id that occurs, counted over all documents; ties go to the smaller id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                n += np.bincount(np.frombuffer(b"".join(b.column(0).slice(s, 512).to_pylist()), "<u2"), minlength=1 << 16)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["id", "n"])

    total = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("count"))
    order = sorted(((-r["count"], r["id"]) for r in total.collect()))  # at most one row for each id of the vocabulary
    return tokens.sparkSession.createDataFrame([(i, -n, k) for k, (n, i) in enumerate(order)], "id int, count long, rank int")


def write(tokens: DataFrame, folder: str) -> None:
    """Writes a token table as files in ascending doc_id order, and deletes it if it is a written step.

    Rows that repeat an id are ordered by a hash of their codes, so that the
    files don't depend on the order of the input; null ids come first.
    """
    spark = tokens.sparkSession
    ranks = ranks_of(tokens)
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    table = spark.read.parquet(f"{folder}/ranks").toPandas()  # at most one row for each id of the vocabulary
    rank = np.zeros(1 << 16, np.uint32)
    rank[table["id"].to_numpy()] = table["rank"].to_numpy()
    held = spark.sparkContext.broadcast(rank)
    files = max(1, -(-int(table["count"].sum()) // FILE_IDS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                n = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                wide = -(-n // 4) * 4
                ends = np.cumsum(wide)
                ranks = np.zeros(int(ends[-1]), np.uint32)
                slot = np.arange(int(n.sum())) + np.repeat(ends - wide - (np.cumsum(n) - n), n)
                ranks[slot] = held.value[np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2")]
                control, data = encode(ranks)
                size = np.r_[0, np.cumsum(TOTAL[control])]
                c, d = control.tobytes(), data.tobytes()
                cuts = [(int(x - w) // 4, int(x) // 4) for x, w in zip(ends, wide, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array([c[x:y] for x, y in cuts], pa.binary()), pa.array([d[size[x] : size[y]] for x, y in cuts], pa.binary())],
                    ["doc_id", "n", "control", "data"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            ids, n, control, data = zip(*rows, strict=True)
            c, d = b"".join(control), b"".join(data)
            raw = struct.pack(HEAD, MAGIC, part, len(rows), len(c), len(d), before) + np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes() + np.array(n, "<u4").tobytes() + c + d
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["value"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(row)
                size += row[1]
                if size >= BLOCK_IDS:
                    yield block()
                    before, rows, size = before + size, [], 0
        if rows:
            yield block()

    # Written, since a range partitioning reads its input twice.
    packed = written(tokens.select("doc_id", "ids", "n").mapInArrow(pack, "doc_id long, n long, control binary, data binary"), "packed")
    superseded(tokens)
    # Rows of one id, or of none, lie in the order of a hash, over as many files as they fill.
    ordered = packed.withColumn("h", F.xxhash64("control", "data")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    # The text sink writes the bytes of a string column as they are, one block and "\n" a row.
    ordered.mapInArrow(blocks, "value binary").select(F.col("value").cast("string")).write.text(f"{folder}/blocks", lineSep="\n")
    superseded(packed)


def read(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """(doc_id, part, before, ids binary of little-endian uint32) of every document in the files of a folder.

    `before`: ids of the part's documents before this one. With `digests` their
    number and CRC-32 stand in place of the ids: n_tokens, ids_crc32.
    """
    table = spark.read.parquet(f"{folder}/ranks").toPandas()
    ids_of = np.zeros(max(1, len(table)), "<u4")
    ids_of[table["rank"].to_numpy()] = table["id"].to_numpy()
    held = spark.sparkContext.broadcast(ids_of)

    names = ["doc_id", "part", "before", *(["n_tokens", "ids_crc32"] if digests else ["ids"])]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                raw, at = memoryview(content.as_buffer()), 0
                while at < len(raw):
                    magic, part, docs, nc, nd, before = struct.unpack_from(HEAD, raw, at)
                    if magic != MAGIC:
                        raise ValueError("not a block of token files")
                    at += struct.calcsize(HEAD)
                    doc_id = np.frombuffer(raw, "<i8", docs, at)
                    n = np.frombuffer(raw, "<u4", docs, at + 8 * docs).astype(np.int64)
                    at += 12 * docs
                    ids = held.value[decode(np.frombuffer(raw, np.uint8, nc, at), np.frombuffer(raw, np.uint8, nd, at + nc))]
                    at += nc + nd + 1
                    first = np.cumsum(-(-n // 4) * 4) - -(-n // 4) * 4
                    cut = [ids[s : s + k] for s, k in zip(first.tolist(), n.tolist(), strict=True)]
                    own = [pa.array(n), pa.array([zlib.crc32(x) for x in cut], pa.int64())] if digests else [pa.array([x.tobytes() for x in cut], pa.binary())]
                    cols = [pa.array(doc_id, mask=doc_id == NO_ID), pa.array(np.full(docs, part, np.int32)), pa.array(before + np.cumsum(n) - n), *own]
                    yield pa.RecordBatch.from_arrays(cols, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{folder}/blocks").select("content")
    return files.mapInArrow(parse, "doc_id long, part int, before long, " + ("n_tokens long, ids_crc32 long" if digests else "ids binary"))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a folder."""
    rows = written(read(spark, folder, digests=True), "digest")
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))  # one row a file
    base = sizes.select("part", (F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("base"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def save(docs: DataFrame, tokenizer: str, folder: str, drops_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the token files. Null texts are empty; an empty table writes no block."""
    write(written(token_table(docs, tokenizer, drops_space, id_col, text_col).select("doc_id", "ids", "n"), "tokens"), folder)
