"""Toxic spans and document scores by a linear-chain conditional random field.

Documents are labelled, tokens are not. Within the training documents, words
and word beginnings that occur significantly and mostly in toxic
documents mark the tokens of those documents; tokens of clean documents are
all clean. A two-state chain is fitted to these token labels. Marginals of the
forward-backward pass over a whole text give the offending offsets (tokens at
0.5 or more) and, summed and at their largest, the inputs of a logistic
regression for the document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: Bounds of the training sample: toxic and clean documents, and characters of
#: each; longer texts are not trained on. Scoring has no such bound.
TOXIC_DOCS, CLEAN_DOCS, TRAIN_CHARS = 1500, 4500, 20_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: By the length of a word, the lengths of its beginnings.
_CUTS = [tuple(k for k in PREFIXES if k <= n) for n in range(PREFIXES[-1] + 1)]
#: How many times as many toxic as clean training documents have a marker.
MARKER_ODDS = 4
WINDOW = 10  # tokens on either side of a training token
#: Training tokens of a document: marked ones of a toxic one, unmarked ones like them of a clean one, any others of either.
MARKED, ALIKE, OTHERS = 12, 4, (3, 1)
#: Tokens of one segment of a long chain. Messages pass between segments exactly.
SEGMENT = 1024
POINTS = ".,;:!?\"'()[]{}|<>-_*#/\\=+~`"
SCORE = "struct<score: double, spans: array<struct<start: int, end: int>>>"


def features(word: str) -> list[str]:
    """The word without points around it, in lower case, and its beginnings."""
    w = word.strip(POINTS).lower()
    return ["w:" + w, *("p:" + w[:k] for k in PREFIXES if len(w) >= k)] if w else []


def _sketch(words: list[str]) -> tuple[int, int]:
    """Two min-hashes of a text's word triples; near copies share one of them most of the time."""
    grams = {zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))}
    return min(grams), min(g * 2654435761 % (1 << 32) for g in grams)


def _marginals(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Probability of state 1 of every token of chains that lie one after the other in `unary`.

    All chains advance together, one token a step, longest chains first; with
    two states a message is one number, the ratio of its two entries. `before`
    and `after` are the messages that enter at the ends of segments (nan where a
    chain begins, 1 where it ends).
    """
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    e = np.exp(np.clip(unary, -40, 40))
    t = np.exp(np.clip(trans, -20, 20))
    ahead, back = np.empty(len(e)), np.empty(len(e))
    steps = int(size[0]) if len(size) else 0
    active = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
    r = np.full(len(size), np.nan) if before is None else before[order]
    for k in range(steps):
        n = active[k]
        at, r = first[:n] + k, r[:n]
        step = e[at] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
        r = np.where(np.isnan(r), e[at], step) if k == 0 else step
        ahead[at] = r
    s = np.ones(len(size)) if after is None else after[order]
    for k in range(steps - 1, -1, -1):
        n = active[k]
        at = first[:n] + k
        back[at] = s[:n]
        x = e[at] * s[:n]
        s[:n] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
    odds = ahead * back
    return odds / (1 + odds)


def _through(unary: np.ndarray, first: np.ndarray, size: np.ndarray, begins: np.ndarray, t: np.ndarray, backward: bool) -> np.ndarray:
    """What each segment does to a message that passes it: a scaled 2 x 2 matrix over (ratio, 1)."""
    out = np.broadcast_to(np.eye(2), (len(first), 2, 2)).copy()
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        e = np.exp(np.clip(unary[first[on] + (size[on] - 1 - k if backward else k)], -40, 40))
        step = np.empty((len(on), 2, 2))
        if backward:
            step[:, 0, 0], step[:, 0, 1], step[:, 1, 0], step[:, 1, 1] = t[1, 1] * e, t[1, 0], t[0, 1] * e, t[0, 0]
        else:
            step[:, 0, 0], step[:, 0, 1], step[:, 1, 0], step[:, 1, 1] = t[1, 1] * e, t[0, 1] * e, t[1, 0], t[0, 0]
            if k == 0:  # no step leads to the first token of a chain
                step[begins[on]] = np.stack([np.stack([np.zeros_like(e), e], 1), np.stack([np.zeros_like(e), np.ones_like(e)], 1)], 1)[begins[on]]
        now = step @ out[on]
        out[on] = now / now.max(axis=(1, 2), keepdims=True)
    return out


def marginals(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Exact marginals of whole texts, however long.

    Texts beyond SEGMENT tokens are cut; the messages at the cuts come from the
    products of their segments' matrices, so cuts change nothing but rounding,
    and a text's marginals don't depend on the others.
    """
    lengths = np.asarray(lengths, np.int64)
    parts = np.maximum(1, -(-lengths // SEGMENT))
    if (parts == 1).all():
        return _marginals(unary, lengths, trans)
    t = np.exp(np.clip(trans, -20, 20))
    text = np.repeat(np.arange(len(lengths)), parts)
    own = np.cumsum(parts) - parts  # the first segment of each text
    number = np.arange(len(text)) - own[text]
    first = (np.cumsum(lengths) - lengths)[text] + number * SEGMENT
    size = np.minimum(SEGMENT, lengths[text] - number * SEGMENT)
    many = np.flatnonzero(parts[text] > 1)
    at = np.full(len(text), -1)
    at[many] = np.arange(len(many))
    ahead, back = (_through(unary, first[many], size[many], number[many] == 0, t, x) for x in (False, True))
    before, after = np.full(len(text), np.nan), np.ones(len(text))
    for k in range(1, int(parts.max())):
        to = own[parts > k] + k
        m, r = ahead[at[to - 1]], np.nan_to_num(before[to - 1], nan=1.0)
        before[to] = (m[:, 0, 0] * r + m[:, 0, 1]) / (m[:, 1, 0] * r + m[:, 1, 1])
    for k in range(int(parts.max()) - 1, 0, -1):
        of = own[parts > k] + k
        m, s = back[at[of]], after[of]
        after[of - 1] = (m[:, 0, 0] * s + m[:, 0, 1]) / (m[:, 1, 0] * s + m[:, 1, 1])
    return _marginals(unary, size, trans, before, after)


@dataclass
class Model:
    """bias and weights score a token's state 1, trans[i, j] the step from i to j; doc: logistic regression on sum and largest marginal."""

    bias: float = -8.0
    weights: dict[str, float] = field(default_factory=dict)
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray = field(default_factory=lambda: np.array([-8.0, 0.0, 0.0]))
    limit: int = 200_000  # words whose scores a worker keeps

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}
        self._parts: tuple[dict[str, float], dict[str, float]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_parts": None}

    def _of(self, words: set[str]) -> Iterator[tuple[str, float]]:
        """Words with their scores: the bias and the weights of their features."""
        whole, lead = (part.get for part in self._parts)
        longest = len(_CUTS) - 1
        for word in words:
            w = word.strip(POINTS).lower()
            out = self.bias + whole(w, 0.0) if w else self.bias
            for k in _CUTS[min(len(w), longest)]:
                out += lead(w[:k], 0.0)
            yield word, out

    def unary(self, texts: list[list[str]]) -> np.ndarray:
        if self._parts is None:
            self._parts = tuple({f[2:]: x for f, x in self.weights.items() if f[:2] == kind} for kind in ("w:", "p:"))
        known = self._known
        new = {w for words in texts for w in words if w not in known}
        if len(known) + len(new) > self.limit:
            known.clear()
            new = {w for words in texts for w in words}
        known.update(self._of(new))
        return np.concatenate([np.fromiter(map(known.__getitem__, words), np.float64, len(words)) for words in texts]) if texts else np.empty(0)

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all tokens, the number of tokens of each text, and the texts' scores."""
        unary, sizes = [np.empty(0)], []
        for s in range(0, len(texts), 64):  # words of a few texts at a time
            words = [t.split() for t in texts[s : s + 64]]
            sizes += map(len, words)
            unary.append(self.unary(words))
        n = np.array(sizes, np.int64)
        p = marginals(np.concatenate(unary), n, self.trans)
        x = _summary(p, n)
        return p, n, 1 / (1 + np.exp(-np.clip(x @ self.doc, -30, 30)))

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and for each text the code points [start, end) of runs of toxic tokens."""
        p, n, score = self.tag(texts)
        spans: list[list[tuple[int, int]]] = []
        for text, s, k in zip(texts, np.cumsum(n) - n, n, strict=True):
            found: list[tuple[int, int]] = []
            hit = np.flatnonzero(p[s : s + k] >= 0.5)
            if len(hit):
                at, last = [m.span() for m in re.finditer(r"\S+", text)], -2
                for i in hit.tolist():
                    if i == last + 1:
                        found[-1] = (found[-1][0], at[i][1])
                    else:
                        found.append(at[i])
                    last = i
            spans.append(found)
        return score, spans


def _summary(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text: 1, log(1 + sum of marginals), largest marginal."""
    out = np.zeros((len(n), 3))
    out[:, 0] = 1
    some = np.flatnonzero(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        out[some, 1] = np.log1p(np.add.reduceat(p, first))
        out[some, 2] = np.maximum.reduceat(p, first)
    return out


def _markers(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Features that stand significantly, and mostly, in toxic documents. One kind of them is counted at a time."""
    plain: dict[str, str] = {}

    def distinct(words: list[str]) -> set[str]:
        return {plain.get(w) or plain.setdefault(w, w.strip(POINTS).lower()) for w in words} - {""}

    bad, good = [distinct(w) for w in toxic], [distinct(w) for w in clean]
    base = len(toxic) / (len(toxic) + len(clean))
    kinds, found = 0, []
    for n in (0, *PREFIXES):
        cut = (lambda words, n=n: {w[:n] for w in words if len(w) >= n}) if n else (lambda words: words)
        pos = Counter(f for words in bad for f in cut(words))
        kinds += len(pos)
        pos = {f: k for f, k in pos.items() if k >= 3}
        neg = Counter(f for words in good for f in cut(words) if f in pos)
        found += [(("p:" if n else "w:") + f, k, neg[f]) for f, k in pos.items()]
    out = set()
    for f, k, m in found:
        g = k * math.log(k / (k + m) / base) + (m * math.log(m / (k + m) / (1 - base)) if m else 0)
        if k >= MARKER_ODDS * m and g >= math.log(kinds) + 2:
            out.add(f)
    return out


def fit(texts: list[str], labels: list[int], rounds: int = 80, seed: int = 7) -> Model:
    """Fits the chain and the document regression. Without both labels the model calls every text clean."""
    toxic, clean, seen = [], [], set()
    once: dict[str, str] = {}  # one object for each word, however often it occurs
    for text, y in zip(texts, labels, strict=True):
        words = [once.setdefault(w, w) for w in text.split()]
        sketch = _sketch(words)
        if words and not (("a", sketch[0]) in seen or ("b", sketch[1]) in seen):  # copies would make all their words markers
            seen |= {("a", sketch[0]), ("b", sketch[1])}
            (toxic if y else clean).append(words)
    if not toxic or not clean:
        return Model()
    marks = _markers(toxic, clean)
    rng = np.random.default_rng(seed)
    chains: list[tuple[list[str], list[int]]] = []
    for words, y in [*((w, 1) for w in toxic), *((w, 0) for w in clean)]:
        tags = [int(bool(y) and any(f in marks for f in features(w))) for w in words]
        like = [i for i, w in enumerate(words) if any(f in marks for f in features(w))]
        centres = rng.permutation(like)[: MARKED if y else ALIKE].astype(int).tolist()
        centres += rng.integers(0, len(words), OTHERS[0] if not y else OTHERS[1]).tolist()
        for c in centres:
            s = slice(max(0, c - WINDOW), c + WINDOW + 1)
            chains.append((words[s], tags[s]))
    wide = 2 * WINDOW + 1
    count = Counter(f for words, _ in chains for w in set(words) for f in features(w))
    number = {f: i + 2 for i, f in enumerate(f for f, n in count.items() if n >= 3)}  # 0: no feature, 1: bias
    rows: dict[str, list[int]] = {}
    ids = np.zeros((len(chains), wide, 2 + len(PREFIXES)), np.int32)
    y = np.zeros((len(chains), wide), np.int64)
    mask = np.zeros((len(chains), wide), bool)
    for i, (words, tags) in enumerate(chains):
        for j, w in enumerate(words):
            if w not in rows:
                r = [1, *(number.get(f, 0) for f in features(w))]
                rows[w] = r + [0] * (2 + len(PREFIXES) - len(r))
            ids[i, j] = rows[w]
        y[i, : len(tags)] = tags
        mask[i, : len(tags)] = True
    theta, trans = np.zeros(len(number) + 2), np.zeros((2, 2))
    theta[1] = -3
    flat, live = ids.reshape(-1, ids.shape[2]), mask.ravel()
    pair = mask[:, 1:] & mask[:, :-1]
    seen_pairs = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    target = np.bincount(flat[live & (y.ravel() == 1)].ravel(), minlength=len(theta)).astype(float)
    columns = [np.ascontiguousarray(flat[live, j]) for j in range(flat.shape[1])]
    size = float(len(chains))
    m1, m2 = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4)
    for step in range(1, rounds + 1):
        u = sum(theta[ids[:, :, j]] for j in range(ids.shape[2]))  # column by column: the driver's memory is small
        e = np.stack([np.ones_like(u), np.exp(np.clip(u, -30, 30))], axis=2)
        e[~mask] = 1
        t = np.exp(np.clip(trans, -20, 20))
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for k in range(1, wide):
            a = (alpha[:, k - 1] @ t) * e[:, k]
            a = np.where(mask[:, k, None], a, alpha[:, k - 1])
            alpha[:, k] = a / a.sum(axis=1, keepdims=True)
        beta[:, -1] = 1
        for k in range(wide - 2, -1, -1):
            b = (e[:, k + 1] * beta[:, k + 1]) @ t.T
            b = np.where(mask[:, k + 1, None], b, 1.0)
            beta[:, k] = b / b.sum(axis=1, keepdims=True)
        p = alpha * beta
        p = (p[:, :, 1] / p.sum(axis=2)).ravel()
        two = alpha[:, :-1, :, None] * t * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        two = two / two.sum(axis=(2, 3), keepdims=True)
        p = p[live]
        expect = sum(np.bincount(column, p, len(theta)) for column in columns)
        g = (target - expect) / size - 1e-4 * theta
        g[0] = 0
        gt = (seen_pairs - two[pair].sum(axis=0)) / size - 1e-4 * trans
        grad = np.r_[g, gt.ravel()]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        theta, trans = theta + move[:-4], trans + move[-4:].reshape(2, 2)
        theta[0] = 0
    model = Model(float(theta[1]), {f: float(theta[i]) for f, i in number.items() if abs(theta[i]) > 1e-3}, trans)
    sums = []
    for s in range(0, len(toxic) + len(clean), 256):
        some = (toxic + clean)[s : s + 256]
        n = np.array([len(w) for w in some], np.int64)
        sums.append(_summary(marginals(model.unary(some), n, trans), n))
    model._known.clear()
    x, want = np.concatenate(sums), np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    w = np.zeros(3)
    del once
    for _ in range(60):  # Newton steps of the regularised regression
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
        w = w + np.linalg.solve(h, x.T @ (want - q) - np.array([1e-3, 1e-2, 1e-2]) * w)
    model.doc = w
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fifth that is never trained on; a row without an id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on labelled documents outside the held-out fifth: at most TOXIC_DOCS and CLEAN_DOCS of them, chosen by a hash of their ids.

    Labels without id or mark are left out; an id with several marks is toxic if one is.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    picks = [known.where(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n) for cond, n in (("y = 1", TOXIC_DOCS), ("y = 0", CLEAN_DOCS))]
    texts = docs.where(F.length(text_col) <= TRAIN_CHARS).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got: list[tuple[str, int]] = []
    for pick, n in zip(picks, (TOXIC_DOCS, CLEAN_DOCS), strict=True):
        rows = texts.join(F.broadcast(pick), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(n)  # the sample is bounded
        got += [(r["text"], r["y"]) for r in rows.collect()]
    return fit([t for t, _ in got], [y for _, y in got])


def scorer(spark, model: Model):
    """A function of a text column: score and spans. A null text is empty."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SCORE)
    def run(text: pa.Array) -> pa.Array:
        scores, spans = [], []
        for s in range(0, len(text), 2048):
            a, b = held.value.score([t or "" for t in text.slice(s, 2048).to_pylist()])
            scores.append(a)
            spans += b
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        lists = pa.array([[{"start": x, "end": y} for x, y in one] for one in spans], kind)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.empty(0)), lists], ["score", "spans"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans of every row, whole texts.

    Null and empty texts get the score of a text without toxic words. Rows that
    repeat an id, or have none, are scored each; other columns are left out.
    """
    got = scorer(docs.sparkSession, model)(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), got.alias("r")).select("doc_id", "r.score", "r.spans")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with a score below the threshold, with all their columns, whatever their names."""
    (got,) = free_names(docs, "toxicity")
    return docs.withColumn(got, scorer(docs.sparkSession, model)(F.col(text_col))).where(F.col(f"{got}.score") < threshold).drop(got)
