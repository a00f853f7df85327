"""Embedding near-duplicates of labels that are cut into tiles."""

from pathlib import Path

import numpy as np

from larkspur.llm import embedding_dedup, warc


def test_large_labels_are_not_replicated(spark, monkeypatch):
    """A label of several tiles against brute force, from files and by Spark; what is written stays near the input's size."""
    r = np.random.default_rng(5)
    base = r.standard_normal((400, 64))
    x = np.concatenate([base, *(base + 0.02 * r.standard_normal(base.shape) for _ in range(3)), base[:100]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    table = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3).cache()
    size, real = [], embedding_dedup.written

    def written(df, name="step"):
        out = real(df, name)
        size.append(sum(f.stat().st_size for f in Path(out._step.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(embedding_dedup, "written", written)
    want = {i: (int(near[i].sum()) - 1, int(np.flatnonzero(near[i]).min())) for i in range(len(x))}
    for ranged in (warc.RANGED, ()):
        monkeypatch.setattr(warc, "RANGED", ranged)
        got = {a.vec_id: (a.n_links, a.component_id) for a in embedding_dedup.groups(table, split=300).collect()}
        assert got == want
    assert sum(size) / 2 < 2 * x.astype("f4").nbytes
