"""Steps whose memory must not grow with the tables."""

import pytest
from pyspark.sql import functions as F

from tesselar.operators import validate as v
from tesselar.plans import catalog, fixtures
from tesselar.plans.model import TopologyError

CHUNKS = "name string, chunk_idx int, offsets array<bigint>, shape array<bigint>, tensor_shape array<bigint>"


def test_manifest_in_several_rows(spark):
    """A manifest may come in rows with a part of its tensors each; its rules hold over all rows."""
    entry = '"{0}":{{"type":"Shared","shape":[{1},2],"dtype":"F32","filename_indices":[0,{2}]}}'
    head = '{"tensors":{},"filenames":["x","y"],"world_size":2}'
    parts = ['{"tensors":{' + entry.format(f"t{i}", i + 1, 1) + "}}" for i in range(50)]
    topology = catalog.parse_manifest(spark.createDataFrame([(p,) for p in [*parts, head]], "value string"))
    assert topology.world_size == 2 and topology.files.count() == 2 and topology.chunks.count() == 100
    assert sorted((r["name"], *r["shape"]) for r in topology.tensors.collect()) == sorted((f"t{i}", i + 1, 2) for i in range(50))
    with pytest.raises(TopologyError, match="DuplicateIndices"):  # one tensor in two rows
        catalog.parse_manifest(spark.createDataFrame([(p,) for p in [*parts, parts[0], head]], "value string"))


def test_untiled_and_sweep_move_rows_once(spark, tmp_path, monkeypatch):
    """Lines are dealt by order once, in parts that grow in number with the table; sums and gaps need no further shuffle."""
    monkeypatch.setattr(fixtures, "TASK_ROWS", 1000)
    spark.range(5000).select(
        (F.col("id") / 3).cast("bigint").alias("l_orderkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit(1).cast("bigint").alias("l_suppkey")
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    chunks = fixtures.order_chunks(spark, str(tmp_path))
    assert chunks.rdd.getNumPartitions() == 6
    for found in (v.untiled(fixtures.shifted(chunks)), v.sweep(fixtures.thinned(chunks))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning(name") <= 2, plan
        assert found.count() > 0


def test_untiled_without_filled_chunks(spark):
    rows = [
        ("empty", 0, [0], [0], [4]), ("none", 0, [0], [0], [0]), ("scalar", 0, [], [], []), ("twice", 0, [], [], []), ("twice", 1, [], [], []),
        ("good", 0, [0, 0], [1, 2], [2, 2]), ("good", 1, [1, 0], [1, 2], [2, 2]), ("cross", 0, [0, 0], [1, 1], [2, 2]), ("cross", 1, [1, 1], [1, 1], [2, 2]),
    ]
    assert {r["name"] for r in v.untiled(spark.createDataFrame(rows, CHUNKS)).collect()} == {"empty", "twice", "cross"}
