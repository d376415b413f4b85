"""Samples are looked up where they are used, and compared without shuffling equal vectors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.operators import donors as dn
from flowlens.operators import quality as dq
from flowlens.plans import base, catalogue  # noqa: F401
from flowlens.plans import split_queries as sq

SMOKE = "/root/testdata/sf0.001"


def test_no_view_holds_vectors_of_samples(spark):
    base.release()
    rows, drafts = sq._samples(spark, SMOKE), sq._drafts(spark, SMOKE)
    assert rows.count() == drafts.count() > 0
    held = {name: table for (_, _, name), table in base._SHARED.items()}
    assert "_sides" in held and not {"_samples", "_encoded"} & set(held)
    assert not any("array<array" in t for _, t in held["_sides"].dtypes)
    assert rows.drop("x").exceptAll(drafts.select(rows.drop("x").columns)).count() == 0
    base.release()


def test_vectors_by_name_give_the_same_mixtures(spark):
    draw = np.random.default_rng(1)
    x = {i: [draw.normal(size=3).tolist() for _ in range(2)] for i in range(5)}
    marks = [(i, i % 5, [1, i % 2], [i % 2, 0], [i, i + 1]) for i in range(12)]
    named = spark.createDataFrame(marks, "sequence_id bigint, start bigint, mask array<int>, y_bucket array<int>, flow_counts array<bigint>")
    vectors = spark.createDataFrame([(i, v) for i, v in x.items()], "start bigint, x array<array<double>>")
    plan = spark.createDataFrame([(100 + i, i, -1 if i % 3 else (i + 1) % 12, i % 2 if i % 3 == 0 else 0) for i in range(12)], "sample_id bigint, left_id bigint, right_id bigint, shift int")
    whole = dn.compose_samples(plan, named.join(vectors, "start").drop("start"), 1.0, 2.0)
    got = dn.mixed_sides(dn.with_vectors(dn.marked(dn.both_sides(plan, named, "start")), vectors, "start"), plan.columns, 1.0, 2.0)
    assert got.columns == whole.columns and got.orderBy("sample_id").collect() == whole.orderBy("sample_id").collect()


def test_vectors_of_several_widths():
    """Rows of other sizes than their neighbours are mixed one by one."""
    x = [[[3.0, 4.0]], [[1.0, 2.0, 2.0]], []]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.list_(pa.float64()))), pa.array([[1.0], [1.0], []], pa.list_(pa.float64())), pa.array([[0.0], [0.0], []], pa.list_(pa.float64())), pa.array([0, 0, 0], pa.int32()), pa.array([None] * 3, pa.list_(pa.list_(pa.float64()))), pa.array([None] * 3, pa.list_(pa.float64()))], names=["_left_x", "_left_mask", "flow_counts", "shift", "_right_x", "_right_mask"])
    got = dn.mixed_vectors(batch, 0.0, 1.0).to_pylist()
    assert np.allclose(got[0], [[0.6, 0.8, 0.0]]) and np.allclose(got[1], [[1 / 3, 2 / 3, 2 / 3, 0.0]]) and got[2] == []


def test_export_is_compared_by_tolerance_where_digests_differ(spark):
    schema = "sample_id bigint, x array<array<double>>, mask array<int>, y_bucket array<int>, flow_counts array<bigint>"
    row = lambda i, e=0.5: (i, [[e, 1.0]], [1], [0], [i])
    odd = float("inf")
    rebuilt = spark.createDataFrame([*(row(i) for i in range(6)), row(6, odd), (7, [[None, 1.0]], [1], [0], [7])], schema)
    samples = spark.createDataFrame([row(0), row(1, 0.5 + 1e-6), row(2, 0.6), row(3), row(3), row(9), row(6, odd), (7, [[None, 1.0]], [1], [0], [7]), (4, [[0.5]], [1], [1], [4])], schema)
    carried = []
    whole = dq.validate_export(samples, rebuilt).first().asDict()
    again = dq.validate_export(samples, rebuilt, again=lambda ids: carried.append(sorted(r[0] for r in ids.collect())) or (samples, rebuilt)).first().asDict()
    # 2 lies off, 4 is shorter, 5 is missing, 9 is not planned; infinity and null cannot be told
    assert whole == again == {"missing_samples": 1, "unplanned_samples": 1, "repeated_samples": 1, "vectors_differ": 6, "mask_differ": 2, "y_bucket_differ": 3, "flow_counts_differ": 2}
    assert carried == [[1, 2, 4, 6, 7]]
    assert dq.validate_export(rebuilt.where("sample_id < 6"), rebuilt.where(F.col("sample_id") < 6)).first()["vectors_differ"] == 0
