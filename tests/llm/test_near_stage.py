"""The near-duplicate stage of the pipeline links by SimHash; similarity is verified and completed."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import near_dedup, simhash


def texts() -> list[str]:
    r = np.random.default_rng(8)
    words = [f"w{k}" for k in range(5000)]
    base = [[words[k] for k in r.integers(0, 5000, 300)] for _ in range(6)]
    return [" ".join(b) for b in base] + [" ".join([*b[:-1], "end"]) for b in base] + [" ".join([*b[:290], *words[:10]]) for b in base]


def test_simhash_links_without_other_candidates(spark, monkeypatch):
    """With bands that no two documents share, what fingerprints link and is similar still goes."""
    data = texts()
    fp = [simhash.fingerprint(t.encode(), 5) for t in data]
    sets = [near_dedup.shingles(t.encode()) for t in data]
    near = [(i, j) for i in range(len(data)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= simhash.RADIUS and near_dedup.jaccard(sets[i], sets[j]) >= 0.8]
    assert near
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near(spark, docs, "").collect()} == set(range(6))
    real = near_dedup.signatures
    monkeypatch.setattr(near_dedup, "signatures", lambda *a: real(*a).withColumn("bands", F.array("doc_id")))
    assert {r.doc_id for r in corpus_pipeline.drop_near(spark, docs, "").collect()} == set(range(len(data))) - {i for i, _ in near}
