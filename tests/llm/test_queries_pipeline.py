import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F
from support import same_as_sql
from test_dedup import brute_components, brute_print, lower

from quarry.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows_as_sql(name, spark, duck):
    assert same_as_sql(queries.QUERIES[name], oracles.ORACLES[name], spark, duck)


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    base = [prose(rng, rng.choice([5, 60, 200])) for _ in range(60)]
    rows = list(enumerate([*base, *base[:10], *(t.upper() for t in base[10:15]), None, "", *(t + " vilest wretched vilest" for t in base[20:50])]))
    docs = documents(spark, rows, source=[rng.choice("abc") for _ in rows])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int("vilest" in (t or ""))) for k, t in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen[name], now = (now.collect(), spark.read.parquet(str(tmp_path / name)).collect()), spark.read.parquet(str(tmp_path / name))
    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {k for k, t in rows if "vilest" in (t or "")} >= gone and len(gone) >= 25
    before, after = seen["exact_dedup"]
    best = {}
    for r in before:
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())
    before, after = seen["near_dedup"]
    prints = {r.doc_id: brute_print(r.text) for r in before}
    roots, least = brute_components(prints.values()), {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    assert sorted(r.doc_id for r in after) == sorted(least.values())
    before, after = seen["mixing"]
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(size(after) - 1.5 * size(before)) <= 3
    before, after = seen["packing"]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    assert sum(r.length for r in after) == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    assert np.mean([r.length for r in after]) > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    top = Path(queries.__file__).resolve().parent.parent
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "quarry.llm" in p.read_text()]


def test_pipeline_stages_bound_the_batches_that_workers_get(spark, tmp_path):
    """10 000 rows a batch are as many bytes as their texts have, which workers and executors then keep."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 5000).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(55_000).cast("long").alias("n_chars"))
    sent = lambda: docs.mapInArrow(largest, "n long").agg(F.max("n")).first()[0]
    spark.createDataFrame([(k, 1, k % 2) for k in range(3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.conf.unset(key)
    try:
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs.limit(3), str(tmp_path))
            assert sent() <= corpus_pipeline.BATCH_BYTES + 200_000, name
            spark.conf.unset(key)
        spark.conf.set(key, "1m")  # the session's own bound stays
        corpus_pipeline.drop_copies(spark, docs.limit(3), str(tmp_path))
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
