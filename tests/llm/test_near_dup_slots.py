"""Counts of shingles are handed on in few rows (check's fail of op1_near_dedup and pipeline, FINDINGS_r03.md)."""

import numpy as np

from larkspur.llm import near_dup


def test_a_task_hands_on_a_row_a_range_of_counters(spark):
    rng = np.random.default_rng(1)
    sets = [rng.integers(-(2**63), 2**63 - 1, 300).tolist() for _ in range(40)] + [[5, 5 + near_dup.SLOTS, 5]]
    expected = np.bincount(np.concatenate([np.array(x, np.int64) for x in sets]).view(np.uint64) % np.uint64(near_dup.SLOTS), minlength=near_dup.SLOTS)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(sets)], "doc long, set array<long>").repartition(6)
    assert (near_dup._slots(df) == expected).all()
    assert near_dup._ranges(np.flatnonzero(expected), expected[expected > 0]).num_rows <= near_dup.RANGES
    assert near_dup._ranges(np.zeros(0, np.int64)).num_rows == 0


def test_shingles_of_one_class_are_left_out_and_shared_ones_kept(spark):
    shared, own = list(range(1, 11)), [[k * 1000 + j for j in range(10)] for k in range(3)]
    sets = spark.createDataFrame([(k, shared + own[k]) for k in range(3)], "doc long, set array<long>").repartition(3)
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "doc long, class long")
    found = near_dup._refined(members, sets, 0.1)
    assert {r.bucket for r in found.collect()} <= set(shared)
    assert found.groupBy("doc").count().count() == 3
