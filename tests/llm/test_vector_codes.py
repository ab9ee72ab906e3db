import hashlib

import duckdb
import numpy as np
import pytest

from talkweave.llm.q_codes import SQL
from talkweave.llm.vector_codes import Tree, books_digest, compress, walk


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd over the rows (vec_id, vector, label)."""
    ok = [r for r in rows if r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1])]
    x = np.array([[int(np.floor(1024 * np.float64(c))) for c in r[1]] for r in ok], dtype=np.int64)
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, tuple(x[i])))[:entries]
    width = x.shape[1] // parts
    code, error, text = [""] * len(ok), np.zeros(len(ok), dtype=np.int64), []
    for p in range(parts):
        y = x[:, p * width : (p + 1) * width]
        book = y[order].copy()
        for k in range(rounds + 1):
            d = ((y[:, None] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if k < rounds:
                for z in set(near.tolist()):
                    own = y[near == z]
                    book[z] = [int(c) // len(own) for c in own.sum(0)]
        for i in range(len(ok)):
            code[i] += f"{near[i]:02x}"
        error += d.min(1)
        text += [str(c) for c in book.reshape(-1)]
    total = {}
    for r, e in zip(ok, error.tolist(), strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(text).encode()).hexdigest()
    return sorted(((r[0], c, e, total[r[2]]) for r, c, e in zip(ok, code, error.tolist(), strict=True)), key=repr), digest


def fixture(seed, n, clusters):
    g = np.random.default_rng(seed)
    base = g.normal(size=(clusters, 8))
    rows = []
    for i in range(n):
        v = np.float32(base[g.integers(clusters)] + g.normal(size=8) * g.choice([0, 0.01, 0.2]))
        rows.append((int(i * 7 % n), [float(c) for c in v], None if i % 11 == 0 else int(g.integers(0, 3)), "x"))
    rows += [(5, None, 1, "x"), (6, [float("nan")] + [1.0] * 7, 1, "x"), (7, [None] + [1.0] * 7, 1, "x"), (8, [], None, "x"), (9, [float("-inf")] * 8, 1, "x")]
    rows += [(3, rows[0][1], 1, "x"), (3, rows[0][1], 1, "x"), (None, rows[1][1], 2, "x"), (n + 1, [-1e-9] * 8, 2, "x"), (n + 2, [0.5] * 8, 2, "x"), (n + 3, [0.5] * 8, 2, "x")]
    return rows


@pytest.mark.parametrize(("n", "clusters", "block", "leaf"), [(900, 40, 8192, 32), (700, 5, 64, 4), (60, 9, 16, 1)])
def test_equals_plain_lloyd(spark, n, clusters, block, leaf):
    rows = fixture(n, n, clusters)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(3)
    coded, books = compress(vectors, leaf_rows=leaf, block_rows=block)
    want, digest = brute([r[:3] for r in rows])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()), key=repr) == want
    assert books_digest(books) == digest
    if n == 700:
        con = duckdb.connect()
        con.register("embeddings", vectors.toArrow())
        got = con.execute(SQL).fetchall()
        assert sorted((tuple(r[:4]) for r in got), key=repr) == want and {r[4] for r in got} == {digest}


def test_whole_subtrees_are_assigned():
    g = np.random.default_rng(1)
    x = (np.arange(4000)[:, None] % 4 * 5000 + g.integers(-20, 20, size=(4000, 3))).astype(np.int64)
    book = np.array([[0, 0, 0], [5000, 5000, 5000], [10000, 10000, 10000], [15000, 15000, 15000], [0, 0, 0]])
    tree = Tree(x, 16)
    tree = Tree.unpack(tree.pack(), len(x), 3, 16)
    kept, tree.points = tree.points, np.full_like(tree.points, np.nan)  # points are not looked at
    sums, counts, *_ = walk(tree, book, False)
    near = ((kept[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert counts.tolist() == np.bincount(near, minlength=5).tolist() and counts[4] == 0
    assert all((sums[z] == kept[near == z].sum(0)).all() for z in range(4))


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label string"
    assert compress(spark.createDataFrame([], kind))[0].count() == 0
    assert compress(spark.createDataFrame([(1, None, "a")], kind))[0].count() == 0
    assert compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], "a")], kind))[0].count() == 0
    rows = [(1, [1.0] * 4, "a"), (2, [1e30] + [0.0] * 3, "a"), (3, [1.0] * 8, None), (4, [1.5] * 4, None)]
    coded, books = compress(spark.createDataFrame(rows, kind))
    got = {r.vec_id: (r.label, r.code, r.error, r.label_error) for r in coded.collect()}
    assert got == {1: ("a", "00000000", 0, 0), 2: ("a", None, None, 0), 4: (None, "01010101", 0, 0)} and [len(b) for b in books] == [2] * 4
