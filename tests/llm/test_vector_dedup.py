"""Embedding near-duplicates against brute force over all pairs."""

import math

import numpy as np
import pytest

from sightline.llm import vector_dedup as vd
from sightline.llm.salting import join_to_rows

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, threshold=0.93):
    """(id, n_links, component_id, kept) of each row, by all pairs."""
    def vector(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.float32(v).astype(float)
        return v / np.linalg.norm(v)

    units = [vector(v) if label is not None else None for _, v, label in rows]
    near = [[] for _ in rows]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                near[i].append(j)
                near[j].append(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        members, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in members:
                    members.add(j)
                    todo.append(j)
        seen |= members
        least = min((rows[j][0] for j in members if rows[j][0] is not None), default=None)
        for j in members:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return out


def planted(rng, n, dims, cosines, labels=2):
    """Random vectors, each with chance one half followed by a partner at one of the given cosines."""
    rows = []
    while len(rows) < n:
        x = rng.standard_normal(dims)
        x /= np.linalg.norm(x)
        label = int(rng.integers(labels))
        rows.append((len(rows), x.tolist(), label))
        if rng.random() < 0.5:
            y = rng.standard_normal(dims)
            y -= (y @ x) * x
            c = float(rng.choice(cosines))
            y = c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)
            rows.append((len(rows), (y * 3).tolist(), label))
    return rows


def check(spark, rows, search=vd.Search()):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vd.near_duplicate_vectors(df, search=search).collect()]
    return sorted(map(repr, found)), sorted(map(repr, brute(rows)))


def test_cases(spark):
    base = [0.1 * k for k in range(1, 9)]
    rows = [
        (1, base, 1), (2, base, 1), (2, base, 1), (3, base, 2), (4, [x * 1e30 for x in base], 1), (5, None, 1), (5, None, 1), (6, [], 1),
        (7, [0.0] * 8, 1), (8, [1.0, None] + base[2:], 1), (9, [float("nan")] + base[1:], 1), (10, [float("inf")] + base[1:], 1), (11, base, None),
        (None, base, 1), (None, [-x for x in base], 1), (12, base[:4], 1), (13, base[:4], 1), (14, [-0.0] * 7 + [1.0], 5), (15, [0.0] * 7 + [1.0], 5),
        (16, [1e-30 * x for x in base], 1),
    ]
    found, wanted = check(spark, rows)
    assert found == wanted


def test_empty(spark):
    assert vd.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, None, 1, "")], SCHEMA)
    assert [tuple(r) for r in vd.near_duplicate_vectors(one).collect()] == [(1, 0, 1, True)]


def test_one_cell_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = planted(rng, 700, 64, [0.92, 0.929, 0.931, 0.94, 0.97, 0.995])
    found, wanted = check(spark, rows)
    assert found == wanted


@pytest.mark.parametrize("spread", [4.0, 8.0])
def test_many_cells_and_tiles(spark, spread):
    """Cells of about 60 vectors, tiles of 40, a dense group: nothing lost, nothing counted twice."""
    rng = np.random.default_rng(2)
    rows = planted(rng, 800, 64, [0.931, 0.935, 0.95, 0.99], labels=1)
    centre = rng.standard_normal(64)
    rows += [(5000 + k, (centre + 0.06 * rng.standard_normal(64)).tolist(), 0) for k in range(150)]
    rows += [(6000 + k, rows[0][1], 0) for k in range(40)]
    found, wanted = check(spark, rows, vd.Search(cell=60, tile=40, spread=spread))
    assert found == wanted


def test_recall_at_the_threshold():
    """Partners exactly at the threshold meet in a common cell in more than 99.9 % of cases."""
    rng = np.random.default_rng(4)
    search, n = vd.Search(), 4000
    x = vd.unit(rng.standard_normal((n, 64)))
    y = rng.standard_normal((n, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * vd.unit(y)
    pivots = vd.unit(rng.standard_normal((500, 64)))
    cells = []
    for side in (x, y):
        home, row, cell = vd.route(side, pivots, search.margin(64))
        cells.append((home, set(zip(row.tolist(), cell.tolist()))))
    (hx, sx), (hy, sy) = cells
    met = [hx[i] == hy[i] or (i, hy[i]) in sx or (i, hx[i]) in sy for i in range(n)]
    assert np.mean(met) > 0.999
    assert np.mean(hx != hy) > 0.1 and len(sx) < 30 * n


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    pivot = 0.3 * vd.unit(rng.standard_normal((1, 64)))[0]
    x, y = vd.unit(rng.standard_normal((2000, 64)) + 0.3), vd.unit(rng.standard_normal((200, 64)) + 0.3)
    truth = (y - pivot) @ (x - pivot).T
    errors, outside = [], []
    for seed in range(5):
        codes = vd.Codes(*vd.encode(x, pivot, seed), 64, 4.0)
        estimate, error = codes.estimate((y - pivot) @ vd.rotation(64, seed).T)
        errors.append((estimate - truth).mean())
        outside.append((np.abs(estimate - truth) > error).mean())
    assert abs(np.mean(errors)) < 0.004
    assert max(outside) < 2e-4


def test_salted_join(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 0, id) AS k")
    results = rows.groupBy("k").count()
    joined = join_to_rows(rows, results, ["k"], "id")
    assert joined.columns == ["k", "id", "count"]
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(results, "k").collect()))
