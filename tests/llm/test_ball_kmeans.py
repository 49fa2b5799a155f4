import hashlib

import numpy as np
import pytest

import data
import oracle
from lodestone.llm import ball_kmeans


def plain(rows, k, rounds, dim=64):
    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    kept = [(i, [max(-(1 << 26), min(1 << 26, c)) for c in v]) for i, v in kept]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign() if kept else []
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, sum(x for x, y in own if y == c), sum(x for x, _ in own), sha[c]) for (i, _), (d, c) in zip(kept, own)), key=repr)


def test_hard_rows(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.integers(-3, 4, 64).astype(float).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [0.5] * 63), (103, [float("nan")] * 64), (104, [None] + [1.0] * 63), (105, [float("-inf")] + [1.0] * 63), (106, [0.0] * 64), (107, [0.0] * 64), (None, [1.0] * 64), (None, [1.5] * 64)]
    rows += [(7, rows[7][1]), (8, [2.0] * 64), (200, [1e30] + [0.0] * 63), (201, [-0.0001] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, x int")
    for k, rounds in [(8, 10), (3, 2), (1, 1), (200, 3)]:
        got = sorted((tuple(r) for r in ball_kmeans.ball_kmeans(df, k, rounds).collect()), key=repr)
        assert got == plain(rows, k, rounds)
    assert ball_kmeans.ball_kmeans(df.limit(0)).count() == 0


def test_oracle(spark):
    import __spark_entry__ as entry

    assert oracle.same(entry.queries()["op12_ball_kmeans"](spark, data.SF), oracle.duck(data.SF).sql(entry.oracle_sql()["op12_ball_kmeans"])) is None


@pytest.mark.parametrize("spread", [1, 50, 4000])
def test_balls_spare_comparisons(spread):
    rnd = np.random.default_rng(spread)
    centres = rnd.integers(-spread * 40, spread * 40, (30, 8))
    x = centres[rnd.integers(0, 30, 3000)] + rnd.integers(-20, 21, (3000, 8))
    want, dist = ball_kmeans.nearest(x, centres)
    own, least, made = ball_kmeans.reassign(x, rnd.integers(0, 30, 3000).astype(np.int32), centres, ball_kmeans._gaps(centres))
    assert (own == want).all() and (least == dist).all()
    own, least, made = ball_kmeans.reassign(x, want, centres, ball_kmeans._gaps(centres))
    assert (own == want).all() and made < 29 * 3000
    if spread == 4000:
        assert made == 0  # all members lie in their balls' stable cores
