"""Near copies of the pipeline against all pairs of shingle sets."""

import random

import numpy as np

import corpus_pipeline
from larkspur.llm import near_dedup


def test_near_stage_drops_planted_copies(spark):
    """Copies at 0.8 to 0.95, case variants, chains and one dense cluster, against brute force."""
    r, data = random.Random(3), []

    def text(n):
        return [f"w{r.randrange(5000)}" for _ in range(n)]

    for n in (40, 120, 400, 1500):
        for share in (0.80, 0.82, 0.86, 0.9, 0.95, 0.78, 0.5):
            base = text(n)
            kinds = n - 4
            gone = int(kinds * (1 - share) / (1 + share))  # shingles that the copy loses and gains
            copy = [*base]
            for i in range(gone // 5):
                copy[4 + 5 * i] = f"new{r.random()}"
            data += [" ".join(base), " ".join(copy), " ".join(base).upper() + " "]
    base = text(300)
    for _ in range(60):  # copies of one text, some further from each other than from the text
        copy = [*base]
        for i in r.sample(range(300), r.randint(1, 9)):
            copy[i] = "other"
        data.append(" ".join(copy))
    chain = text(200)
    for k in range(8):
        data.append(" ".join(chain[k * 10 :] + [f"end{i}" for i in range(k * 10)]))
    data += ["a b", "A  b", "a c", "one two three four five", ""]
    docs = spark.createDataFrame([*enumerate(data), (None, "a b")], "doc_id long, text string").repartition(3)
    sets = [near_dedup.shingles(t.encode()) for t in data]
    low = list(range(len(data)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in range(len(data)):
        for j in range(i + 1, len(data)):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                low[b] = a
    assert {r.doc_id: r.component_id for r in near_dedup.groups(docs).collect()} == {i: find(i) for i in range(len(data))}
    blocks = near_dedup.groups(docs, block=3).collect()  # clusters beyond a block
    assert {r.doc_id: r.component_id for r in blocks} == {i: find(i) for i in range(len(data))}
    left = corpus_pipeline.drop_near(spark, docs, "")
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {None, *(i for i in low if find(i) == i)}
    assert near_dedup.dedup(docs.limit(0)).count() == 0


def test_connecting_edges():
    r = random.Random(1)
    base = list(range(100))
    sets = [np.array(sorted({*r.sample(base, 85), *range(1000 + 20 * i, 1000 + 20 * i + r.randrange(20))}), np.uint64) for i in range(40)] + [np.empty(0, np.uint64)]
    n = len(sets)
    sim = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
    comp = np.array([i if i % 3 else 0 for i in range(n)])
    outside = np.flatnonzero(comp != 0)
    got = near_dedup.connecting(np.arange(n), comp, outside, np.arange(n), sets, 0.7)

    def joined(edges):
        low = {int(c): int(c) for c in comp}

        def find(x):
            while low[x] != x:
                x = low[x]
            return x

        for a, b in edges:
            x, y = sorted((find(int(comp[a])), find(int(comp[b]))))
            low[y] = x
        return [find(int(c)) for c in comp]

    every = [(i, j) for i in range(n) for j in range(n) if i != j and sim(sets[i], sets[j]) >= 0.7]
    assert all((a, b) in every for a, b in got) and joined(got) == joined(every) and len(got) < n
    assert near_dedup.connecting(np.arange(0), np.arange(0), np.arange(0), np.arange(0), [], 0.7) == []


def test_odd_rows_of_the_near_stage(spark):
    """Repeated ids, null ids and texts, columns with clashing names."""
    docs = spark.createDataFrame([(3, "a b c", 1), (3, "a b c", 2), (1, "x", 3), (2, "X ", 4), (None, "x", 5), (7, None, 6), (8, "", 7)], "doc_id long, text string, gone int")
    left = near_dedup.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r.gone for r in left.collect()) == [1, 2, 3, 5, 6]
