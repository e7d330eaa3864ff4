import math

import numpy as np
import pytest

from passageworks.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, id string, v int, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1, "c") for i, v in rows], SCHEMA).repartition(4)


def exact(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {ids[i]: [(ids[j], s[i, j]) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def clustered(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    x = centres[rng.integers(0, 8, n)] + 0.6 * rng.standard_normal((n, d))
    x[1::5] = x[::5][: len(x[1::5])] + 0.15 * rng.standard_normal((len(x[1::5]), d))  # near copies
    return [(i, v * rng.uniform(0.1, 20)) for i, v in enumerate(x)]


def test_pairs_over_a_floor_and_the_ten_best(spark):
    rows = clustered(1500)
    true = exact(rows, 10)
    df = frame(spark, rows)
    got = {(r["vec_id"], r["neighbour"]): r["cosine"] for r in N.similar(df, floor=0.88, dimensions=16, cell_vectors=100).collect()}
    wanted = {(i, j): s for i, best in true.items() for j, s in best if s >= 0.88}
    assert len(set(got) & set(wanted)) >= 0.97 * len(wanted) and all(got[p] == pytest.approx(wanted[p], abs=1e-5) for p in set(got) & set(wanted))
    assert min(got.values()) >= 0.88
    best = {}
    for r in N.similar(df, dimensions=16, probes=8, cell_vectors=100, queries=lambda x: x % 20 == 0).collect():
        best.setdefault(r["vec_id"], set()).add(r["neighbour"])
    assert set(best) == {i for i in range(0, 1500, 20)} and all(len(b) == 10 for b in best.values())
    assert np.mean([len(b & {j for j, _ in true[i]}) / 10 for i, b in best.items()]) >= 0.9


def test_blocks_give_what_one_group_gives(spark, monkeypatch):
    df = frame(spark, clustered(300, 8, 3))
    whole = {(r["vec_id"], r["neighbour"]) for r in N.similar(df, k=5, dimensions=8, probes=1, cell_vectors=10_000).collect()}
    monkeypatch.setattr(N, "BLOCK_DATA", 70)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 90)
    assert {(r["vec_id"], r["neighbour"]) for r in N.similar(df, k=5, dimensions=8, probes=1, cell_vectors=10_000).collect()} == whole


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    same = rng.standard_normal(4)
    rows = [(i, same) for i in range(100, 140)] + [(i, rng.standard_normal(4)) for i in range(10)]
    bad = [(200, None), (201, [0, 0, 0, 0]), (202, [1, 2, 3]), (203, [1, math.nan, 0, 0]), (204, [1, math.inf, 0, 0]), (205, [1, None, 0, 0])]
    df = frame(spark, [*rows, rows[0], rows[-1], *bad])
    got = {}
    for r in N.similar(df, k=10, dimensions=4).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"], r["score"]))
    assert set(got) == {i for i, _ in rows}
    for i in range(100, 140):  # the ten copies of lowest id, without itself
        assert [j for _, j, _ in sorted(got[i])] == [j for j in range(100, 112) if j != i][:10]
        assert all(s == pytest.approx(1) for *_, s in got[i])
    assert all(len(v) == 10 and i not in {j for _, j, _ in v} for i, v in got.items())


def test_every_class_answers_once_if_centroids_tie():
    rng = np.random.default_rng(6)
    c = rng.standard_normal((60, 8)).astype(np.float32)
    c[20:40] = c[0]
    c /= np.linalg.norm(c, axis=1)[:, None]
    v = np.concatenate([c, (c[:1] + 0.01 * rng.standard_normal((200, 8))).astype(np.float32)])
    for probes in (1, 3, 60, 99):
        cell, home = N.Cells(c).visited(v, probes)
        assert (home.sum(axis=1) == 1).all() and (cell[home] == (v @ c.T).argmax(axis=1)).all()
        assert all(len(set(x)) == min(probes, 60) for x in cell.tolist())
    assert len(N.fit_cells(v[np.r_[:60, [0] * 40]], 50)) == len(np.unique(N.fit_cells(v[np.r_[:60, [0] * 40]], 50), axis=0))


def test_grouped_cells_are_nearly_those_of_all(spark):
    rng = np.random.default_rng(7)
    c = rng.standard_normal((3000, 16)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1)[:, None]
    v = (c[rng.integers(0, 3000, 500)] + 0.1 * rng.standard_normal((500, 16))).astype(np.float32)
    cell, home = N.Cells(c, grouped=100).visited(v, 3)
    assert (home.sum(axis=1) == 1).all() and all(len(set(x)) == 3 for x in cell.tolist())
    assert (cell[home] == (v @ c.T).argmax(axis=1)).mean() >= 0.97


def test_windows_count_what_lies_inside():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((130, 8)).astype(np.float32)
    a = N.lines(8, 7)
    lines = N._Lines(x, a)
    windows = N._Windows(lines, (x[:20] @ a).T)
    for half in (0.1, 0.5, 2.0):  # counts are carried from one width to the next
        windows.widen(np.float32(half))
        p = x @ a
        counts = (np.abs(p[:20, None] - p[None]) <= np.float32(half)).sum(axis=2)
        for need in (1, 3, 7):
            bits = np.unpackbits(windows.at_least(need).view(np.uint8), axis=1, bitorder="little", count=130)
            assert (bits == (counts >= need)).mean() > 0.999


def test_a_third_of_the_rows_equal_loses_no_pair(spark):
    rng = np.random.default_rng(8)
    same = rng.standard_normal(16)
    near = [(i, same + 0.15 * rng.standard_normal(16)) for i in range(300)]
    rows = near + [(i, rng.standard_normal(16)) for i in range(300, 1000)] + [(i, same) for i in range(1000, 1500)]
    # k above the number of copies that stand for their class, so that other classes are neighbours too
    true = {(i, j) for i, best in exact(near, 10).items() for j, s in best if s >= 0.9}
    got = {(r["vec_id"], r["neighbour"]) for r in N.similar(frame(spark, rows), k=10, floor=0.9, dimensions=16, probes=8, cell_vectors=20, queries=lambda x: x >= 1000).collect()}
    assert {i for i, _ in got} == set(range(1000, 1500)) and all(j >= 1000 for _, j in got) and true
    asked = {r["vec_id"] for r in N.similar(frame(spark, rows), k=10, floor=0.9, dimensions=16, probes=3, cell_vectors=20, queries=lambda x: x < 300).collect()}
    x = same / np.linalg.norm(same)
    assert asked >= {i for i, v in near if v @ x / np.linalg.norm(v) >= 0.9}


def test_nothing_and_one(spark):
    df = frame(spark, [(1, [1, 0])])
    assert N.similar(df, dimensions=2).count() == 0 and N.similar(df.limit(0), dimensions=2).count() == 0 and N.similar(df, dimensions=3).count() == 0


def test_collisions_find_what_is_near():
    x = np.array([v for _, v in clustered(800, 32, 9)], np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, d, c = N.search_block(x, x[::10], 11, 0.88, N.lines(32))
    found = {(int(a) * 10, int(b)) for a, b in zip(q, d)}
    s = x[::10] @ x.T
    wanted = {(i * 10, int(j)) for i in range(80) for j in np.argsort(-s[i])[:11] if s[i, j] >= 0.88}
    assert len(found & wanted) >= 0.97 * len(wanted)
