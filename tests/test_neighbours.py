"""Neighbour graphs by descent against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.operators import neighbours

SCHEMA = "vec_id long, embedding array<double>, nb int"


def exact(x: np.ndarray, k: int) -> np.ndarray:
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("kind", ["clusters", "plain"])
def test_most_neighbours_are_found(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 24))
    if kind == "clusters":
        x = x * 0.4 + rng.normal(size=(40, 24))[rng.integers(0, 40, 1200)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA).repartition(4)
    found: dict[int, list[tuple]] = {}
    for r in neighbours.descent_graph(df, 5, block=64, trees=4, width=20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    want = exact(x, 5)
    hits = sum(len({i for _, i, _ in found[q]} & set(want[q].tolist())) for q in range(1200))
    assert hits >= 0.9 * 1200 * 5
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1200, 97):
        rows = sorted(found[q])
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and q not in [r[1] for r in rows] and len({r[1] for r in rows}) == 5
        assert [r[2] for r in rows] == pytest.approx([1 - u[q] @ u[i] for _, i, _ in rows], abs=1e-8) and [r[2:] for r in rows] == sorted(r[2:] for r in rows)


def test_small_and_odd_tables(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (None, [1.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (8, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r["rank"], r.id) for r in neighbours.descent_graph(df, 2).collect())
    # 7 has another length than all others, and so nothing to be near to
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
    assert neighbours.descent_graph(df.limit(0), 2).count() == 0


def test_copies_of_one_vector_don_t_meet_all_at_once(spark):
    """A third of all rows are one vector: lists stay bounded, and each finds copies at distance 0."""
    rng = np.random.default_rng(3)
    x = np.vstack([np.ones((300, 8)), rng.normal(size=(600, 8))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA).repartition(4)
    rows = neighbours.descent_graph(df, 3, block=64, trees=3, width=12, rounds=3).collect()
    own = [r for r in rows if r.query_id < 300]
    assert len(own) == 900 and all(r.distance == 0 and r.id < 300 for r in own)


def test_codes_travel_and_vectors_decide(spark):
    """What a round shuffles is some bytes for each component of those who meet, not eight; distances are those of the vectors, however far a code is off."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 256))
    x[:, 0] *= 40  # codes of such vectors are coarse
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA).repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(s.shuffleWriteBytes() for s in (lambda q: [q.apply(i) for i in range(q.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = shuffled()
    rows = neighbours.descent_graph(df, 4, width=16, rounds=2, least=0.0).collect()
    assert shuffled() - before < 24 << 20
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(rows) == 4000 and [r.distance for r in rows] == pytest.approx([1 - u[r.query_id] @ u[r.id] for r in rows], abs=2e-9)
