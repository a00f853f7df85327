"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer texts are cut first, between a character other than white space and
#: white space that follows it: no match of the pattern spans such a place.
LONG = 1 << 16
_SAFE = regex.compile(r"(?<=\S)(?=\s)")

_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The encoding of a rank file; one for each worker process."""
    import tiktoken

    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """A text in parts of about `long` characters that can be encoded on their own."""
    start = 0
    while len(text) - start > long:
        m = _SAFE.search(text, start + long)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str, enc) -> np.ndarray:
    """Ids of a text as uint32, as encode_ordinary of the whole text gives them."""
    return np.concatenate([np.array(enc.encode_ordinary(p), "<u4") for p in pieces(text)])


def decode(ids: np.ndarray, enc) -> bytes:
    """The raw bytes of ids; they need not be valid UTF-8."""
    return enc.decode_bytes(ids.tolist())


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, ids binary of little-endian uint32, decoded binary) of every row, or with `digests` their sizes and SHA-256.

    A null text is empty: no ids. Rows that repeat an id, or have none, are rows
    of their own; other columns are left out. Texts may be of any length; one
    without white space is encoded whole. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                ids = [encode(t or "", enc) for t in b.column(1).to_pylist()]
                raw = [decode(x, enc) for x in ids]
                if digests:
                    cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in raw])]
                    yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids binary, decoded binary")
