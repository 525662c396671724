"""Stages of the pipeline on null and repeated ids."""

import numpy as np

import corpus_pipeline


def test_near_duplicates_by_row(spark):
    r = np.random.default_rng(8)
    say = lambda: " ".join(f"q{k}" for k in r.integers(0, 5000, 60))
    a, b, c, d, e, f = (say() for _ in range(6))
    rows = [
        (1, a), (None, a + " tail"), (None, b),  # b has no id, and is alone
        (2, c), (3, c + " tail"), (3, d), (3, d),  # 3 has two texts, and d is alone
        (None, e), (None, e + " tail"), (None, e),  # no ids at all
        (4, f), (4, f + " tail"),  # one id, near each other
        (5, ""), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()), key=repr)
    alone = [(1, a), (None, b), (2, c), (3, d), (5, ""), (None, None)]
    rest = [x for x in got if x not in alone]
    assert len(got) == len(alone) + 2 and all(x in got for x in alone)
    assert sorted((i, t.removesuffix(" tail")) for i, t in rest if i) == [(4, f)]
    assert [t.removesuffix(" tail") for i, t in rest if i is None] == [e]
