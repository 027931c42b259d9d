"""The pipeline's stages against brute force, each on what its predecessor kept."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tamis.llm.common import materialise
from tamis.llm.queries import remainder
from tamis.llm.toxicity import fit_toxicity, score_toxicity


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_every_stage(spark, sf, docs):
    now, after = docs, {}
    for name, stage in C.STAGES:
        after[name] = now, (now := materialise(stage(spark, now, sf), name))
        if name != "packing":
            assert now.columns == docs.columns
    before, kept = after["toxicity"]
    model = fit_toxicity(before, spark.read.parquet(f"{sf}/labels.parquet").filter(remainder(3) != 1))
    low = score_toxicity(before.select("doc_id", "text"), model).filter("toxicity.score < 0.7")
    assert texts(kept) == texts(low)
    before, kept = after["near_duplicates"]
    rows = texts(before)
    of = brute.component_ids(rows, 5)
    assert texts(kept) == [r for r in rows if of[r[0]] == r[0]]
    before, kept = after["decontamination"]
    rows = texts(before)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute.benchmark_hits(rows, items)
    assert [i for i, _ in texts(kept)] == [i for (i, _), (n, hit, _) in zip(rows, hits) if 2 * hit <= n]
    clean = dict(texts(kept))
    assert all(clean[i] == t for (i, t), (_, hit, _) in zip(rows, hits) if not hit)
    assert all(x[1] < n for (i, _), (n, hit, _), x in ((r, h, (0, brute.benchmark_hits([(0, clean.get(r[0], ""))], items)[0][0])) for r, h in zip(rows, hits)) if hit)
    before, kept = after["pii"]
    assert not any(brute.base_spans(t) for _, t in texts(kept))
    assert all(t == u for (_, t), (_, u) in zip(texts(before), texts(kept)) if not brute.base_spans(t) and "=" not in t and "AKIA" not in t)
    assert kept.filter(F.length("text") != F.col("n_chars")).count() == 0
    before, pieces = after["packing"]
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {i for i, _ in texts(before)}


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_odd_and_empty_tables(spark, sf, odd, nothing, stage):
    assert stage(spark, nothing, sf).collect() == []
    out = stage(spark, odd, sf)
    if stage is not C.packing:
        assert out.columns == odd.columns
    assert 0 < out.count()
