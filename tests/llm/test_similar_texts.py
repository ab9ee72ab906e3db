import random

import numpy as np
import pytest

import corpus_pipeline

from talkweave.llm.similar_texts import candidate_roots, keep_one, shingle_set, similar_roots, similar_texts, wide_fingerprint


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows, least=0.8):
    sets, low = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a == b) if not a or not b else len(a & b) >= least * len(a | b) - 1e-9:
                x, y = low[i], low[j]
                low = [min(x, y) if v in (x, y) else v for v in low]
    return [min(i for (i, _), v in zip(rows, low) if v == own and i is not None) for own in low]


def fixture():
    rng, rows = random.Random(5), []
    word = lambda: "w%d" % rng.randrange(5000)
    for g in range(40):
        words = [word() for _ in range(rng.choice([12, 30, 100, 400]))]
        for k in range(40 if g == 3 else 4):
            own = list(words)
            for _ in range(k % 5 * len(words) // 80):  # similarities from 1 down to below 0.8
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, "only two"), (903, "Only  two"), (904, rows[0][1]), (905, rows[0][1])]
    return rows


@pytest.mark.parametrize("cells", [{}, {"cell_rows": 6}, {"cell_bytes": 3000}])
def test_groups_equal_brute_force(spark, cells):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar_texts(docs, **cells).collect()}
    want = {i: low for (i, _), low in zip(rows, groups(rows))}
    assert got == want and 40 < len(set(want.values())) < 160
    if not cells:
        kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
        assert kept == {i for i, low in want.items() if i == low}
        assert similar_texts(docs.limit(0)).count() == 0


def test_short_texts_equal_brute_force(spark):
    """Thousands of texts of five to fourteen words, many with a similarity of just 0.8: none is missed."""
    rng, rows = random.Random(9), []
    for g in range(900):
        words = [f"g{g}w{k}" for k in range(rng.randint(8, 14))]
        rows.append((3 * g, " ".join(words)))
        rows.append((3 * g + 1, " ".join(words[: len(words) - rng.randint(1, 2 if len(words) > 9 else 1)])))
        rows.append((3 * g + 2, " ".join([*words, "more"][rng.randint(0, 1) :])))
    want = {i: low for (i, _), low in zip(rows, grouped(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in similar_texts(docs).collect()} == want
    assert sum(i != low for i, low in want.items()) > 800


def grouped(rows):
    """groups() of rows whose ids are dealt in threes, so that only those need be compared."""
    return [low for k in range(0, len(rows), 3) for low in groups(rows[k : k + 3])]


def test_sizes_apart_are_not_compared_and_others_are(spark):
    from talkweave.llm.similar_texts import candidate_edges

    rows = [(n, n, 5, 6, 7, 8) for n in range(1, 400)]
    nodes = spark.createDataFrame(rows, "nid long, shingles long, w0 long, w1 long, w2 long, w3 long")
    linked = {(r.a, r.b) for r in candidate_edges(nodes, most_rows=64).collect()}
    root = {n: n for n, *_ in rows}
    for a, b in sorted(linked):
        x, y = root[a], root[b]
        root = {n: min(x, y) if v in (x, y) else v for n, v in root.items()}
    assert set(root.values()) == {1, 2, 3}  # from 3 on neighbours chain
    assert all(min(a, b) >= 0.6 * max(a, b) - 1 for a, b in linked)


def test_rows_are_told_apart_by_their_texts(spark):
    a, b = "one text of more than five words", "quite another text of more than five words"
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (None, a, 4), (None, "a text of its own that has no id", 5), (7, None, 6), (8, "", 7), (9, b, 8), (9, b, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumnRenamed("component_id", "rid")
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.rid for r in out.collect()) == [1, 3, 5, 6]


def test_candidates_find_similar_texts():
    """Of pairs with a similarity of just over 0.8, texts of 20 to 400 words, over 99.5 % are candidates; unlike texts hardly ever."""
    rng, found, total = np.random.default_rng(3), 0, 0
    for size in (20, 50, 100, 400):
        for _ in range(250):
            common = rng.integers(0, 2**63, int(size * 0.8) + 1, dtype=np.uint64)
            n = size - len(common)
            sets = [np.concatenate([common, rng.integers(0, 2**63, k, dtype=np.uint64)]) * np.uint64(2654435761) for k in (n // 2, n - n // 2)]
            x = np.stack([wide_fingerprint(np.unique(s)) for s in sets])
            found, total = found + (candidate_roots(x, None, 64)[1] == 0), total + 1
    assert found >= 0.995 * total
    unlike = np.stack([wide_fingerprint(rng.integers(0, 2**63, 100, dtype=np.uint64) * np.uint64(3)) for _ in range(2000)])
    assert (candidate_roots(unlike, None, 64) == np.arange(2000)).all()
    assert (candidate_roots(unlike[:900], unlike[900:], 64) == np.arange(2000)).all()


def test_roots_by_bags():
    sets = [shingle_set(t.encode()) for t in ("a b c d e f g h i j k l", "a b c d e f g h i j k l m", "x y z", "a b c d e f g h i j k l m n", "")]
    assert similar_roots(sets, np.zeros(5), 0.8).tolist() == [0, 0, 2, 0, 4]
    assert similar_roots(sets, np.arange(5), 0.8, np.array([0, 0, 0, 1, 0], dtype=bool)).tolist() == [0, 0, 2, 0, 4]
