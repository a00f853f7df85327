"""Target proportions of many sources, and tables that packing has to bear."""

import numpy as np
import public_tokenizers
import pytest

from larkspur.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def by_rounds(totals, weights, window, grain):
    """Deficit round-robin played round after round: (queue, tokens) served, in order."""
    left, earned, out = list(map(float, totals)), [0.0] * len(totals), []
    served = [0] * len(totals)
    while any(s < t for s, t in zip(served, totals, strict=True)):
        share = window
        while share > 1e-9 and any(x > 1e-9 for x in left):  # a queue that runs dry within a round leaves the rest of its share
            active = [q for q, x in enumerate(left) if x > 1e-9]
            w = sum(weights[q] for q in active)
            part = min(share, min(left[q] * w / weights[q] for q in active))
            for q in active:
                earned[q] += part * weights[q] / w
                left[q] -= part * weights[q] / w
            share -= part
        for q, t in enumerate(totals):
            have = t if left[q] <= 1e-9 else int(earned[q] + 1e-9) // grain * grain
            if have > served[q]:
                out.append((q, have - served[q]))
                served[q] = have
    return out


@pytest.mark.parametrize("seed", range(12))
def test_schedule_against_played_rounds(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 9))
    totals, weights = r.integers(1, 3000, n).tolist(), r.choice([0.5, 1.0, 2.0, 3.0], n).tolist()
    s = packing.Schedule(totals, weights, 64, 8)
    want, at = [], [0] * n
    for q, k in by_rounds(totals, weights, 64, 8):
        want += [(q, at[q] + i) for i in range(k)]
        at[q] += k
    where = {}
    for q, t in enumerate(totals):
        _, pos = s.place(np.full(t, q), np.arange(t))
        where |= {int(p): (q, i) for i, p in enumerate(pos.tolist())}
    got = [where[i] for i in range(sum(totals))]
    # A grain that is earned just at the end of a round may fall to either side of it.
    for q in range(n):
        one, two = (np.cumsum([x == q for x, _ in row]) for row in (got, want))
        assert np.abs(one - two)[63::64].max(initial=0) <= 2 * 8


def test_more_sources_than_a_thousand_keep_their_targets(spark):
    """1500 sources, half of them with three times the weight of the others."""
    docs = spark.createDataFrame([(i, "one two three four " * 130, f"s{i % 1500}") for i in range(3000)], "doc_id long, text string, source string").repartition(3)
    weights = {f"s{i}": 3.0 if i % 2 else 1.0 for i in range(1500)}
    got = packing.pieces(docs, BYTE, weights).selectExpr("doc_id", "length", "sequence_id").collect()
    total = sum(r.length for r in got)
    heavy = [0] * (1 + max(r.sequence_id for r in got))
    for r in got:
        heavy[r.sequence_id] += r.length * (r.doc_id % 2)
    # The heavy half is a third of the way dry when the light one begins its second third: 3/4 of the early windows is its.
    early = len(heavy) // 2
    assert abs(sum(heavy[:early]) / (2048 * early) - 0.75) < 0.05
    assert total == sum({r.doc_id: r.length for r in packing.pieces(docs, BYTE).groupBy("doc_id").sum("length").toDF("doc_id", "length").collect()}.values())


def test_sources_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    docs = spark.createDataFrame([(i, "one two three " * 50, s) for i, s in enumerate(["0", "1", "a", "b", "c", None, "a"])], "doc_id long, text string, source string")
    assert {r.doc_id for r in packing.pieces(docs, BYTE).collect()} == set(range(7))
    with pytest.raises(ValueError, match="sources"):
        packing.pieces(docs, BYTE, {"a": 2.0})


def test_odd_rows_and_clashing_columns(spark):
    """Null and repeated ids are documents of their own; columns of the table never clash with the operator's."""
    docs = spark.createDataFrame([(None, "a b c", "x", 1), (None, None, None, 2), (4, "a b c", "x", 3), (4, "a b c", "x", 3)], "doc_id long, text string, source string, queue int")
    got = packing.pieces(docs, BYTE, {"x": 2.0, "": 1.0}).collect()
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in got) == [(0, 1, 1), (0, 4, 4), (4, 4, 4), (4, 4, 4)]
    assert sorted(r.offset for r in got) == [0, *np.cumsum(sorted((r.offset, r.length) for r in got), axis=0)[:-1, 1].tolist()]
