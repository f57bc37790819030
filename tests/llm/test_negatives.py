"""Norm-bucketed search against a loop over all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, norm string"


def brute(rows, is_anchor, positives=5, count=3, low=50, high=95):
    whole = {}
    for vec, label, v in rows:
        if vec is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[vec, label, tuple(math.floor(256 * x) for x in v)] = None
    out = Counter()
    score = lambda a, b: max(-negatives.LARGEST, min(negatives.LARGEST, sum(x * y for x, y in zip(a, b))))
    for vec, label, v in whole:
        if not is_anchor(vec):
            continue
        scored = sorted((-score(v, w), i, m == label) for i, m, w in whole if i != vec)
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            good = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:count]
            for rank, (t, j, _) in enumerate(good, 1):
                out[vec, i, rank, j, -s, -t] += 1
    return out


def vectors(seed, n, labels=4, width=5, spread=1.0):
    rng = random.Random(seed)
    single = lambda x: float(np.float32(x))
    rows = [(i, rng.randrange(labels), [single(rng.gauss(0.3, 1) * rng.choice([0.1, 1, spread])) for _ in range(width)]) for i in range(n)]
    same = [single(0.5)] * width
    rows += [(n + i, i % 2, same) for i in range(60)]  # one vector under two labels
    rows += [rows[3], rows[3], (rows[3][0], 1, same), (7000, 0, []), (7001, 1, same[:2]), (7002, 2, [0.0] * width)]
    rows += [(None, 0, same), (7003, None, same), (7004, 0, None), (7005, 0, [None] * width), (7006, 0, [math.nan, *same[1:]]), (7007, 1, [math.inf, *same[1:]])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "spread", "bucket", "run"), [(1, 1.0, 512, 8192), (2, 8.0, 4, 16), (3, 40.0, 3, 7)])
def test_mined_equals_all_pairs(spark, monkeypatch, seed, spread, bucket, run):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "RUN", run)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = vectors(seed, 150, spread=spread)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = Counter(map(tuple, negatives.mined(frame, F.col("vec_id") % 5 == 0).collect()))
    assert got == brute(rows, lambda i: i % 5 == 0)


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, [float(rng.randint(-(2**30), 2**30)) * 2.0 ** rng.choice([0, 1, 40]) for _ in range(4)]) for i in range(40)]
    frame = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    exact = [(i, label, [r for r in v]) for i, label, v in ((r.vec_id, r.label, r.embedding) for r in frame.collect())]
    assert Counter(map(tuple, negatives.mined(frame, F.col("vec_id") < 8).collect())) == brute(exact, lambda i: i < 8)


def test_pruning_skips_short_vectors(spark):
    """Candidates that are too short for any window meet no anchor."""
    rows = [(i, i % 2, [4.0, 4.0], "") for i in range(20)] + [(100 + i, i % 2, [0.001, 0.001], "") for i in range(20)]
    known = negatives.usable(spark.createDataFrame(rows, SCHEMA))
    runs = negatives.runs_of(known.where("norm > 10").unionByName(known.where("norm < 10"))).collect()
    assert all(r.top < 10 or r.top > 1000 for r in runs)
    block = negatives.Block(
        pd.DataFrame({"anchor": [1], "vec_id": [0], "label": [0], "v": [[1024.0, 1024.0]], "norm": [1448.2], "asked": [[{"slot": 1, "least": 1 << 20, "most": 1 << 22, "kth": -(1 << 62), "kth_id": 0}]]}), 3
    )
    block.search(1, np.array([5]), np.array([[0.25, 0.25]]), np.array([0.36]), same=False)
    assert not len(block.held[0])
    block.search(1, np.array([6]), np.array([[1024.0, 1024.0]]), np.array([1448.2]), same=False)
    assert block.held[2].tolist() == [6]


def test_empty_and_lonely(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mined(none, F.col("vec_id") % 5 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0], ""), (50, 2, [1.0], "")], SCHEMA)
    assert negatives.mined(alone, F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mined(alone, F.lit(False)).count() == 0


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = negatives.op13_negatives(spark, sf)
    order = found.columns
    want = con.sql(negatives.OP13_SQL)
    got = found.collect()
    assert Counter(map(tuple, got)) == Counter(want.select(*order).fetchall())
    ranks = defaultdict(list)
    for r in got:
        ranks[r.anchor_id, r.positive_id].append(r.rank)
    assert got and all(sorted(x) == list(range(1, len(x) + 1)) for x in ranks.values())
