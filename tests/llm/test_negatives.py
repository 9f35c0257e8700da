"""Hard negatives against brute force, with nulls, ties, repeats, odd vectors and clashing names."""

import math
import random

import numpy as np
import pytest

from citeloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, slot int, p int"


def brute(rows, k=5):
    used = []
    for vec_id, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        used.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    last = lambda i: 1 << 63 if i is None else i
    out = []
    for a in used:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), last(b[0]), b[0], b[1] == a[1]) for b in used if b[0] != a[0]), key=lambda x: x[:2])
        for s, _, i, same in [x for x in scored if x[3]][:k]:
            fits = [(n, j) for n, _, j, alike in scored if not alike and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a[0], i, r, j, -s, -n) for r, (n, j) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def made(n, seed, dim=4):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1.0, -0.25, 0.0, 0.5, 0.75, 1.0, 1.1]) for _ in range(dim)], r.randrange(3), "x", 1, 2) for i in range(n)]
    rows += [rows[100], rows[7], rows[41]]  # repeated rows, one of them an anchor
    rows += [(None, [1.0] * dim, 1, None, None, None), (500_000, None, 1, "", 0, 0), (500_001, [1.0] * dim, None, "", 0, 0), (500_002, [float("nan")] * dim, 1, "", 0, 0)]
    rows += [(500_003, [float("inf"), 1.0], 2, "", 0, 0), (500_004, [None, 1.0], 2, "", 0, 0), (500_100, [], 0, "", 0, 0), (500_200, [1.0], 0, "", 0, 0), (500_201, [2.0] * (dim + 2), 1, "", 0, 0)]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, block_bytes):
    rows = made(620, 5)
    got = hard_negatives.mine(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), block_bytes=block_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(100, [7e5, 1.0], 1), (1, [7e5 + 1, 1.0], 1), (2, [7e5, 0.5], 2), (3, [7e5 - 4, 0.0], 2), (200, [1.0, 1.0], 3)]
    rows = [(i, v, label, "", 0, 0) for i, v, label in rows]
    assert sorted(map(tuple, hard_negatives.mine(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark, spark.createDataFrame([(100, [1e12], 1, "", 0, 0), (1, [1e12], 1, "", 0, 0)], SCHEMA)).collect()


def test_empty_table(spark):
    assert hard_negatives.mine(spark, spark.createDataFrame([], SCHEMA)).count() == 0
