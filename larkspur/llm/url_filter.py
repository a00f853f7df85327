"""URL filter: rules by host and path, and for the rest logistic regression on hashed character n-grams."""

from __future__ import annotations

import csv
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host with path). At most MAX_RULES of them, since they become one expression.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_RULES = 1000
BITS, NGRAMS = 18, (3, 4, 5)
#: Most labelled URLs of a fit, which runs on the driver.
MAX_EXAMPLES = 100_000
TABLE = Path(__file__).with_name("labelled_urls.csv")


def labelled(path: str | Path = TABLE) -> list[tuple[str, int]]:
    """(url, label) of a CSV file with the columns label and url; label 1 is to be blocked."""
    with open(path, encoding="utf-8", newline="") as f:
        return [(r["url"], int(r["label"])) for r in csv.DictReader(f)]

def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ://."""
    _, mark, rest = (url or "").partition("://")
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return (rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:end]) if mark else ("", "")


def grams(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and path, each part marked by its first byte."""
    out = []
    for kind, s in ((b"h", f"^{host}$".encode()), (b"p", f"^{path}$".encode())):
        out += [zlib.crc32(kind + s[i : i + n]) & (1 << BITS) - 1 for n in NGRAMS for i in range(len(s) - n + 1)]
    return np.unique(np.array(out, np.int64))


def fit(examples=None, rounds: int = 400, rate: float = 8.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; rows are scaled to unit length.

    `examples`: (url, label) pairs, 1 to be blocked; by default the labelled table beside this module.
    """
    examples = labelled() if examples is None else examples
    x = [grams(*split_url(u)) for u, _ in examples]
    y = np.array([v for _, v in examples], float)
    row, col = np.repeat(np.arange(len(x)), [len(g) for g in x]), np.concatenate(x)
    val = 1 / np.sqrt(np.array([len(g) for g in x]))[row]
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col] * val, len(x)) + b)))
        g = (p - y) / len(x)
        w -= rate * (np.bincount(col, g[row] * val, len(w)) + decay * w)
        b -= rate * g.sum()
    return w, b


def probability(host: str, path: str, w: np.ndarray, b: float) -> float:
    g = grams(host, path)
    return float(1 / (1 + np.exp(-(w[g].sum() / np.sqrt(max(len(g), 1)) + b))))


def rest_of(url_col: str) -> Column:
    """What follows the first ://, or an empty string."""
    url = f"coalesce(`{url_col}`, '')"
    return F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")


def host_of(url_col: str) -> Column:
    return F.translate(F.regexp_extract(rest_of(url_col), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its action, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):  # the last condition that is put on top is tried first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """The share of pairs of a blocked and an allowed URL in right order."""
    one, two = score[label == 1], score[label == 0]
    return float(((one[:, None] > two[None]) + 0.5 * (one[:, None] == two[None])).mean())


def held_out_scores(examples=None, folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Score and label of every example, by a model fitted without its fold; folds go by host, so that none is known."""
    examples = labelled() if examples is None else examples
    fold = np.array([zlib.crc32(split_url(u)[0].encode()) % folds for u, _ in examples])
    score = np.zeros(len(examples))
    for k in range(folds):
        w, b = fit([e for e, f in zip(examples, fold, strict=True) if f != k])
        for i in np.flatnonzero(fold == k):
            score[i] = probability(*split_url(examples[i][0]), w, b)
    return score, np.array([y for _, y in examples])


def judged(pages: DataFrame, examples=None, rules=RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of a block, of every row.

    The model judges what no rule fits; elsewhere its probability is null. A null
    URL, or one without ://, has empty host and path, which no rule fits. URLs
    may have any length; rows that repeat are judged each; other columns are left
    out. `examples`: (url, label) pairs, or a DataFrame of them of at most
    MAX_EXAMPLES rows, which are collected for the fit.
    """
    if isinstance(examples, DataFrame):
        rows = examples.limit(MAX_EXAMPLES + 1).collect()
        if len(rows) > MAX_EXAMPLES:
            raise ValueError(f"at most {MAX_EXAMPLES} labelled URLs")
        examples = [(r[0], int(r[1])) for r in rows if r[1] is not None]
    w, b = fit(examples)
    held = pages.sparkSession.sparkContext.broadcast((w.astype(np.float32), b))

    @F.arrow_udf("double")
    def model(host: pa.Array, path: pa.Array) -> pa.Array:
        w, b = held.value
        return pa.array([None if h is None else probability(h, p, w, b) for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)], pa.float64())

    rest, host = rest_of(url_col), host_of(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), action.alias("action"))
    scored = ruled.select("*", model(F.when(F.col("action").isNull(), F.col("host")), F.col("path")).alias("block_probability"))
    verdict = F.coalesce("action", F.when(F.col("block_probability") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")
