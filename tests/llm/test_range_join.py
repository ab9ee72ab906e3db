import numpy as np
import pytest

from talkweave.llm.range_join import near_vectors


def brute(rows):
    ok = [v is not None and c is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, c, _ in rows]
    n = len(rows)
    near = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
                near[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.nonzero(near[todo.pop()])[0]:
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], int(near[i].sum()), low, rows[i][0] is not None and rows[i][0] == low))
    return out


@pytest.mark.parametrize(("cell_rows", "tile_rows"), [(8192, 4096), (20, 4096), (30, 17)])
def test_equals_brute_force(spark, cell_rows, tile_rows):
    g = np.random.default_rng(cell_rows)
    rows = []
    for _ in range(40):
        base = g.normal(size=8)
        for _ in range(int(g.integers(1, 8))):
            v = base + g.normal(size=8) * g.choice([0, 0.02, 0.1, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in v * g.choice([1, 1, 3])], int(g.integers(0, 2)), "x"))
    chain = [[float(np.float32(np.cos(a))), float(np.float32(np.sin(a)))] for a in np.arange(0, 3, 0.15)]
    rows += [(1000 - i, v, 5, "x") for i, v in enumerate(chain)]
    rows += [(2000, None, 1, "x"), (2001, [0.0] * 8, 1, "x"), (2002, [float("nan")] + [1.0] * 7, 1, "x"), (2003, [None] + [1.0] * 7, 1, "x"), (2004, rows[0][1], None, "x"), (2005, [], 1, "x"), (None, rows[1][1], rows[1][2], "x"), (2006, rows[1][1], rows[1][2], "x"), (2006, rows[1][1], rows[1][2], "x"), (2007, [1e30] * 8, 1, "x"), (2008, [-0.0, 1.0], 5, "x")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vec string").repartition(3)
    got = near_vectors(docs, cell_rows=cell_rows, tile_rows=tile_rows).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    if tile_rows == 17:
        assert near_vectors(docs.limit(0)).count() == 0


def test_whole_numbers_keep_their_digits(spark):
    """Components of any type but float are compared in double precision: these two differ in the last digit of one."""
    rows = [(1, [16777217, 16777216], 1), (2, [16777216, 16777216], 1), (3, [16777216, -16777216], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<long>, label int"), 1 - 1e-16).collect()}
    assert got[1] == (0, 1) and got[3] == (0, 3)
