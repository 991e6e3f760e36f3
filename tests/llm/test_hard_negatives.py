"""Hard negatives against all products, the tree's bounds, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import hard_negatives as h

SCHEMA = "vec_id bigint, label int, v array<bigint>"
ANCHOR = "vec_id % 10 = 0"


def brute(rows, positives, negatives, low, high):
    """All rows of mine(), by plain loops."""
    rows = [(k, *r) for k, r in enumerate(rows) if None not in r and None not in r[2]]
    width = max((len(r[3]) for r in rows), default=0)
    full = [r[3] + [0] * (width - len(r[3])) for r in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(full[a], full[b], strict=True))
    out = []
    for a, (_, anchor_id, label, _v) in enumerate(rows):
        if anchor_id % 10 == 0:
            scores = [(-dot(a, b), r[1], r[2]) for b, r in enumerate(rows) if b != a]
            for s, positive, _ in sorted(x for x in scores if x[2] == label)[:positives]:
                fit = sorted(x[:2] for x in scores if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
                out += [(anchor_id, positive, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


def vectors(n, seed, width=5, most=40, labels=4):
    r = random.Random(seed)
    out = [(r.choice([k, k, k % 37]), r.randrange(labels), [r.randint(-most // 4, most) for _ in range(r.choice([width, width, width - 1]))]) for k in range(n)]
    return out + out[:7] + [(None, 1, [1]), (5, None, [1]), (6, 1, None), (10, 2, [1, None]), (20, 1, []), (30, 3, [0] * width)]


@pytest.mark.parametrize(("seed", "shard", "leaf", "children", "low"), [(1, 32_768, 64, 64, 80), (2, 40, 3, 3, 80), (3, 25, 2, 8, 0), (4, 60, 1, 2, 95)])
def test_against_all_products(spark, monkeypatch, seed, shard, leaf, children, low):
    monkeypatch.setattr(h, "SHARD_ROWS", shard)
    plain = h.build
    monkeypatch.setattr(h, "build", lambda v, ids: plain(v, ids, leaf, children))
    rows = vectors(260, seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "anchor": F.lit(2), "shard": F.lit(3)}).repartition(3)
    got = sorted(tuple(r) for r in h.mine(df, F.expr(ANCHOR), 3, 4, low, 100).collect())
    assert got == brute(rows, 3, 4, low, 100)
    assert got


def test_large_numbers(spark):
    rows = [(k, k % 2, [(1 << 29) + 977 * k * k, -k, 3]) for k in range(60)]
    assert sorted(tuple(r) for r in h.mine(spark.createDataFrame(rows, SCHEMA), F.expr(ANCHOR)).collect()) == brute(rows, 5, 5, 80, 100)


def test_nodes_cover_their_rows_and_bound_products():
    r = np.random.default_rng(3)
    v = np.concatenate([r.integers(-50, 50, (300, 6)), np.tile(r.integers(-50, 50, (1, 6)), (150, 1))])
    t = h.build(v, np.arange(len(v)), 5, 4)
    own = {"rows": np.arange(len(v)), "ids": np.arange(len(v)), "labels": np.array(["a"] * len(v))}
    tree = h.Tree(h.dump(v=v, **own, **t))
    assert sorted(t["order"].tolist()) == list(range(len(v)))
    q = r.integers(-80, 80, (20, 6))
    low, high = tree.bounds(q.astype(float))
    for n in range(len(t["center"])):
        inside = q @ v[t["order"][t["first"][n] : t["last"][n]]].T
        assert (low[:, n, None] <= inside).all()
        assert (inside <= high[:, n, None]).all()
        assert t["parent"][n] < n
    assert t["leaf"].sum() > 20
    spread = np.concatenate([np.eye(6, dtype=np.int64)[k] * 1000 + r.integers(-3, 4, (50, 6)) for k in range(6)])
    tree = h.Tree(h.dump(v=spread, **{k: x[:300] for k, x in own.items()}, **h.build(spread, np.arange(300))))
    low, high = tree.bounds(spread[:1].astype(float))
    assert (high[0][tree.leaf] < 500_000).any(), "far nodes are skipped"


def test_edges(spark):
    assert h.mine(spark.createDataFrame([], SCHEMA), F.expr(ANCHOR)).count() == 0
    assert h.mine(spark.createDataFrame([(10, 1, [1])], SCHEMA), F.expr(ANCHOR)).count() == 0
    alone = [(10, 1, [2]), (11, 1, [-1]), (12, 2, [-1])]  # a negative positive score has no window
    assert h.mine(spark.createDataFrame(alone, SCHEMA), F.expr(ANCHOR)).count() == 0
    again = [(10, 1, [2]), (10, 1, [2]), (12, 2, [2]), (12, 2, [2])]
    got = sorted(tuple(r) for r in h.mine(spark.createDataFrame(again, SCHEMA), F.expr(ANCHOR)).collect())
    assert got == brute(again, 5, 5, 80, 100) == [(10, 10, 1, 12, 4, 4)] * 2 + [(10, 10, 2, 12, 4, 4)] * 2


def test_scores_beyond_64_bits_fail(spark):
    rows = [(10, 1, [1 << 40]), (11, 1, [1 << 40]), (12, 2, [1 << 40])]
    with pytest.raises(Exception, match="64 bits"):
        h.mine(spark.createDataFrame(rows, SCHEMA), F.expr(ANCHOR)).collect()


def test_integer_vectors(spark):
    rows = [(7, [0.5, -0.001], 9), (8, [0.5, float("inf")], 1), (9, None, 1), (10, [1.0], None), (None, [0.25], 3), (14, [], 3)]
    got = [tuple(r) for r in h.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()]
    assert sorted(got, key=repr) == sorted([(7, 0, [128, -1]), (None, 3, [64]), (14, 4, [])], key=repr)
