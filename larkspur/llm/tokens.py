"""Encoding whole texts with the tokenizers library, one chunk at a time.

Texts are cut where the vocabularies here never merge: around runs of ASCII
white space, and before ASCII points that follow an ASCII letter. A text's ids
are then the ids of its chunks in a row. The cuts of a batch of texts are found
with numpy and its distinct chunks with Arrow; each worker keeps the ids of the
chunks that it has met, and only new ones go through the library, many at once.

The strings of special tokens are ordinary text in a document (`encode_special_tokens`
of the library), so that no text can end or begin a document by itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Appended to each document.
END_ID = 1
#: Bytes of text that are cut at a time; a longer text is cut by itself.
SLICE = 4 << 20
#: Chunks and bytes of chunks that a worker keeps before it begins anew.
KEPT, KEPT_BYTES = 500_000, 32 << 20

#: Classes of bytes; only those below UNSURE are known not to be white space.
LETTER, POINT, OTHER, UNSURE, WHITE, SPACE = range(6)


def _classes() -> np.ndarray:
    c = np.full(256, OTHER, np.uint8)
    c[:32] = UNSURE
    c[127] = UNSURE
    c[[9, 10, 11, 12, 13]] = WHITE
    c[32] = SPACE
    for b in range(33, 127):
        c[b] = LETTER if chr(b).isalpha() else OTHER if chr(b).isdigit() else POINT
    return c


CLASS = _classes()
#: White space of two and three bytes in UTF-8, and marks that some engines count as such.
_WIDE = [bytes(x) for x in ("\x85".encode(), "\xa0".encode(), *(chr(c).encode() for c in (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))]
_WIDE_CODES = np.array(sorted(int.from_bytes(w.ljust(3, b"\0"), "big") for w in _WIDE), np.uint32)
_WIDE_LEADS = sorted({w[0] for w in _WIDE})


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte; all bytes of white space outside ASCII are UNSURE."""
    cls = CLASS[buf]
    at = np.flatnonzero(np.isin(buf, _WIDE_LEADS)) if buf.max(initial=0) >= 0x80 else ()
    if len(at):
        p = np.zeros(len(buf) + 2, np.uint32)
        p[: len(buf)] = buf
        two = buf[at] == 0xC2
        code = p[at] << 16 | p[at + 1] << 8 | np.where(two, 0, p[at + 2])
        hit = np.isin(code, _WIDE_CODES)
        for k in range(3):
            some = at[hit & ~two if k == 2 else hit] + k
            cls[some[some < len(cls)]] = UNSURE
    return cls


def cuts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, drops_space: bool) -> np.ndarray:
    """Where chunks of the texts [starts, ends) of `buf` begin; every text that is not empty begins one.

    With `drops_space` a chunk begins at each run of spaces. Else a run of white
    space is cut before it, before its last character, and after that unless it
    is a space: a pattern match takes all but the last, which may lead a word.
    """
    cut = np.zeros(len(buf) + 1, bool)
    cls = classes(buf)
    cut[1:-1] = (cls[1:] == POINT) & (cls[:-1] == LETTER)
    if drops_space:
        cut[1:-1] |= (cls[1:] == SPACE) & (cls[:-1] != SPACE)
    else:
        white, sure = cls >= WHITE, cls < UNSURE
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = sure[:-1], sure[1:]
        some = ends > starts
        before[starts[some]] = False
        after[ends[some] - 1] = False
        cut[:-1] |= white & (before | after)
        cut[1:] |= white & after & (cls != SPACE)
    cut[starts] = True
    cut[len(buf)] = False
    return np.flatnonzero(cut)


def _byte_names() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = _byte_names()
#: A-Z to lower case and ASCII white space to spaces.
_PLAIN = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of words of Latin letters up to U+024F.
_WORDLY = np.array([chr(b).isalpha() and b < 128 or 0x80 <= b <= 0xBF or 0xC3 <= b <= 0xC9 for b in range(256)])


def _parts(values: pa.Array) -> list[bytes]:
    """The values of a large binary array without nulls; faster than by their scalars."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    raw = values.buffers()[2].to_pybytes() if values.buffers()[2] is not None else b""
    return [raw[a:b] for a, b in pairwise(at)]


class ChunkEncoder:
    """Ids of texts as uint16; equal to encoding each whole text with the library.

    `drops_space`: the tokenizer lower-cases and drops white space; otherwise a
    chunk keeps the space before it.
    """

    def __init__(self, path: str, drops_space: bool, limit: int = KEPT, limit_bytes: int = KEPT_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        # For words of letters alone, the same model without the steps before it: their bytes are mapped here.
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        suffix = {"end_of_word_suffix": model["end_of_word_suffix"]} if model.get("end_of_word_suffix") else {}
        self.words = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, **suffix))
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.drops_space, self.limit, self.limit_bytes = drops_space, limit, limit_bytes
        # A chunk of one token that stands between others.
        self.mark, self.word_mark = (" ^ ", " ^ ") if drops_space else ("\n", f" {BYTES[10]} ")
        self.mark_id = self._ids(self.mark)
        if len(self.mark_id) != 1 or self.words.encode(self.word_mark).ids != self.mark_id.tolist():
            raise ValueError("the mark between chunks has to be one token")
        self._mapped = {b: c for b, c in BYTES.items() if c != chr(b)} | {10: self.word_mark}
        self._clear()

    def _clear(self) -> None:
        """Slots of known chunks; their ids are pool[at[slot] : at[slot] + size[slot]]."""
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.slots = self.used = 0
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, np.uint16)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _keep(self, names: list[bytes], ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Gives chunks their slots; `ids` holds those of chunk k from first[k] on."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.slots + len(names) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        s = slice(self.slots, self.slots + len(names))
        self.at[s], self.size[s] = first + self.used, size
        self.known.update(zip(names, range(s.start, s.stop), strict=True))
        self.used, self.slots, self.held = self.used + len(ids), s.stop, self.held + sum(map(len, names))

    def _marked(self, names: list[bytes], ids: np.ndarray) -> None:
        cut = np.flatnonzero(ids == self.mark_id[0])
        if len(cut) != len(names) - 1:
            raise RuntimeError("chunks and marks don't match")
        first, last = np.r_[0, cut + 1], np.r_[cut, len(ids)]
        self._keep(names, ids, first, last - first)

    def _learn(self, names: list[bytes]) -> None:
        """Encodes chunks that are not known yet: words of letters by the model alone, others in a row, odd ones each by itself."""
        size = np.array([len(c) for c in names], np.int64)
        buf = np.frombuffer(b"".join(names), np.uint8)
        first = np.cumsum(size) - size
        led = buf[first] == 32
        bad = ~_WORDLY[buf]
        bad[1:] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)) | (buf[:-1] == 0xC9) & (buf[1:] >= 0x90)
        if self.drops_space:
            bad[1:] |= (buf[:-1] == 0xC4) & (buf[1:] == 0xB0)  # a capital whose lower case is longer
        bad[first[led]] = False
        word = ~np.logical_or.reduceat(bad, first) & (size > led)
        ascii_ = np.maximum.reduceat(buf, first) < 0x80
        kind = np.where(word, np.where(ascii_, 0, 1), 2)
        if self.drops_space:
            odd = np.logical_or.reduceat(buf == ord("^"), first) | (size == led)
        else:
            cls = classes(buf)
            cls[first[led]] = OTHER
            odd = np.logical_or.reduceat(cls >= UNSURE, first) | (size == led)
        kind[~word & odd] = 3
        for k in range(3):
            some = np.flatnonzero(kind == k).tolist()
            for i in range(0, len(some), 4096):
                part = [names[j] for j in some[i : i + 4096]]
                self._marked(part, self._row(part, k))
        for j in np.flatnonzero(kind == 3).tolist():
            ids = self._ids(names[j].decode())
            self._keep([names[j]], ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def _row(self, names: list[bytes], kind: int) -> np.ndarray:
        if kind == 2:
            return self._ids(self.mark.join([c.decode().strip(" ") if self.drops_space else c.decode() for c in names]))
        text = b"\n".join(names)
        if self.drops_space:
            text = text.replace(b" ", b"")
            text = text.decode().lower().encode() if kind else text
        if kind:
            row = text.decode("latin-1").translate(self._mapped)
        else:
            row = text.decode().replace(" ", BYTES[32]).replace("\n", self.word_mark)
        return np.array(self.words.encode_batch_fast([row], add_special_tokens=False)[0].ids, np.uint16)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a binary array in a row, each text's with END_ID behind them, and where each text's ids end."""
        ids, ends, done = [np.empty(0, np.uint16)], [np.empty(0, np.int64)], 0
        for some in self._slices(texts):
            a, b = self._encode(some)
            ids.append(a)
            ends.append(b + done)
            done += len(a)
        return np.concatenate(ids), np.concatenate(ends)

    @staticmethod
    def _slices(texts: pa.Array) -> Iterator[pa.Array]:
        size = np.array(pc.binary_length(texts).fill_null(0), np.int64)
        step = np.cumsum(size) // SLICE
        s = np.flatnonzero(np.diff(step, prepend=-1))
        for i, j in zip(s.tolist(), [*s[1:].tolist(), len(size)][: len(s)], strict=True):
            yield texts.slice(i, j - i)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        raw = raw.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if raw is not None else pa.py_buffer(b"")
        if self.drops_space:
            raw = pa.py_buffer(raw.to_pybytes().translate(_PLAIN))
        offsets = offsets - offsets[0]
        total = int(offsets[-1])
        first = cuts(np.frombuffer(raw, np.uint8), offsets[:-1], offsets[1:], self.drops_space) if total else np.empty(0, np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.r_[first, total].astype(np.int64)), raw]).dictionary_encode()
        names = _parts(chunks.dictionary)
        own = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(own < 0)
        if self.slots + len(new) > self.limit or self.held > self.limit_bytes:
            self._clear()
            new = np.arange(len(names))
        if len(new):
            some = [names[k] for k in new.tolist()]
            self._learn(some)
            own[new] = np.fromiter(map(self.known.__getitem__, some), np.int64, len(some))
        slot = own[chunks.indices.to_numpy()]
        size = self.size[slot].astype(np.int64)
        end = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[slot] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        # Room for END_ID behind the ids of each text.
        upto = np.r_[0, end][np.searchsorted(first, offsets[1:])] + np.arange(1, n + 1)
        out = np.full(len(ids) + n, END_ID, np.uint16)
        body = np.ones(len(out), bool)
        body[upto - 1] = False
        out[body] = ids
        return out, upto


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, drops_space: bool, kept: int = KEPT) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary."""
    key = (path, drops_space, kept)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, drops_space, kept)
    return _ENCODERS[key]


def binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array over the bytes of `flat`, whose parts end at these elements."""
    offsets = np.r_[0, ends].astype(np.int64) * flat.itemsize
    if offsets[-1] > (1 << 31) - 1:
        raise ValueError("more than 2 GB of ids in one batch")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def token_table(docs: DataFrame, path: str, drops_space: bool, id_col: str = "doc_id", text_col: str = "text", queue_col: str | None = None, kept: int = KEPT) -> DataFrame:
    """(doc_id, ids binary, n, queue, part, at): the ids of each document as uint16, end id included.

    A null text is empty and gives the end id alone. `part` is the task that
    read the row, `at` the ids of the rows of the same queue before it there.
    `kept`: chunks that a worker keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), {}
        enc = encoder(path, drops_space, kept)
        for whole in batches:
            done = 0
            for texts in enc._slices(whole.column(1)):
                c = whole.slice(done, len(texts))
                done += len(texts)
                ids, ends = enc.encode(texts)
                n = np.diff(ends, prepend=0)
                queue = c.column(2).dictionary_encode()
                number = queue.indices.to_numpy()
                starts = np.empty(len(n), np.int64)
                for k, q in enumerate(queue.dictionary.to_pylist()):
                    some = np.flatnonzero(number == k)
                    upto = np.cumsum(n[some]) + at.get(q, 0)
                    starts[some] = upto - n[some]
                    at[q] = int(upto[-1])
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), binary(ids, ends), pa.array(n), c.column(2), pa.array(np.full(len(n), part, np.int32)), pa.array(starts)],
                    ["doc_id", "ids", "n", "queue", "part", "at"],
                )

    queue = F.coalesce(F.col(queue_col).cast("string"), F.lit("")) if queue_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), queue.alias("queue"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n long, queue string, part int, at long")
