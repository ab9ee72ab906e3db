import random

import numpy as np
import pytest
import xxhash

from talkweave.llm.simhash import fingerprint, forest, links, near_duplicates


def slow_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(fps):
    near = {a: {b for b in fps if (a ^ b).bit_count() <= 3} for a in set(fps)}
    out = {}
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = seen
    return out


def test_fingerprint():
    for t in ["", " \t", "a", "A b", "One two THREE four", "É é É é", "x " * 5000, "a\x0bb\x0cc\x1cd e"]:
        assert fingerprint(t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("seed", range(3))
def test_links_and_forest(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 4), dtype=np.uint64)) for _ in range(400)])
    x = np.unique(base[rng.integers(0, 60, 400)] ^ flips)
    a, b = links(x, None, 3)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 3}
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == want
    h = len(x) // 2
    a, b = links(x[:h], x[h:], 3)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in want if i < h <= j}
    root = {i: i for i in range(len(x))} | dict(forest(*links(x, None, 3), len(x)))
    groups = slow_groups(x.tolist())
    assert all((root[i] == root[j]) == (int(x[j]) in groups[int(x[i])]) for i in range(len(x)) for j in range(0, len(x), 7))


@pytest.mark.parametrize("tile_rows", [32768, 7])
def test_groups_equal_brute_force(spark, tile_rows):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(300)]
    rows = []
    for g in range(30):
        words = [rng.choice(vocab) for _ in range(400)]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(400)] = "edit%d" % rng.randrange(1000)
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (901, ""), (902, "only"), (None, rows[0][1]), (None, "alone in null")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    got = near_duplicates(docs, tile_rows=tile_rows).collect()
    fps = [slow_fingerprint(t or "") for _, t in rows]
    groups = slow_groups(fps)
    low = {f: min((i for (i, _), g in zip(rows, fps) if g in groups[f] and i is not None), default=None) for f in fps}
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=key) == sorted([(i, f, low[f]) for (i, _), f in zip(rows, fps)], key=key)
    assert len(set(low.values())) < len(rows) - 20
    assert near_duplicates(docs.limit(0)).count() == 0


def test_dense_groups_keep_a_forest():
    g = np.random.default_rng(3)
    base = g.integers(0, 2**63, 2, dtype=np.uint64)
    x = np.unique(np.concatenate([b ^ (np.uint64(1) << g.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << g.integers(0, 12, 900, dtype=np.uint64)) for b in base]))
    a, b = links(x, None, 3)
    root = {i: i for i in range(len(x))} | dict(forest(a, b, len(x)))
    groups = slow_groups(x.tolist())
    assert len(a) < 700_000 and all((root[i] == root[0]) == (int(x[i]) in groups[int(x[0])]) for i in range(len(x)))
