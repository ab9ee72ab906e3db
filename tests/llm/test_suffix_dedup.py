import hashlib
import random

import numpy as np
import pytest

from talkweave.llm.suffix_dedup import class_of, gram_hashes, repeated_passages, window_least, without_repeats


def brute(rows, span=50):
    first = {}
    big = 1 << 62
    texts = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, b), (shown, _) in zip(texts, rows, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < i:
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((shown, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fixture(seed):
    rng = random.Random(seed)
    words = ["ab", "the", "é", "longer", "passage", "x", "1234", "\n", "übung"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    shared = [say(n) for n in (5, 8, 9, 10, 30, 200)]
    rows = []
    for i in range(60):
        parts = [say(rng.randrange(40)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randrange(6))]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    base = say(60)
    rows += [(100 + i, base) for i in range(5)]  # copies
    rows += [(200 + i, base[:i] + "#" + base[i + rng.randrange(3) :]) for i in range(0, 300, 23)]  # near copies
    rows += [(None, base), (None, say(9) + shared[4]), (300, None), (301, ""), (302, base[:49]), (303, base[:50]), (303, base[:50]), (304, "a" * 400), (305, "a" * 60), (306, "ab" * 90), (50, "b" + "a" * 51), (307, "z" * 49), (308, "z" * 49 + "y")]
    rng.shuffle(rows)
    return rows


def test_hashes_are_of_the_bytes_alone():
    rng = np.random.default_rng(0)
    b = rng.integers(0, 3, 4000).astype(np.uint8)
    for gram in (16, 24, 27):
        h = gram_hashes(b, gram)
        seen = {}
        for p in range(len(b) - gram + 1):
            assert seen.setdefault(b[p : p + gram].tobytes(), int(h[p])) == int(h[p])
        assert len(set(seen.values())) == len(seen)
    v = rng.integers(0, 1000, 300)
    for width in (1, 2, 7, 27):
        assert window_least(v, width).tolist() == [min(v[i : i + width]) for i in range(len(v) - width + 1)]


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (500, 16)).astype(np.uint8)
    rows[:, :12] = 7
    cls, order = class_of(rows.view(">u8"), np.zeros(500, dtype=np.int64))
    texts = [r.tobytes() for r in rows]
    assert [texts[i] for i in order] == sorted(texts)
    assert cls.tolist() == [sorted(set(texts)).index(t) for t in texts]


@pytest.mark.parametrize(("seed", "gram", "rows", "splitters"), [(0, 24, 1 << 20, 1 << 14), (1, 24, 50, 7), (2, 19, 200, 2)])
def test_equals_brute_force(spark, seed, gram, rows, splitters):
    data = fixture(seed)
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, block int").repartition(3)
    got = repeated_passages(docs, gram=gram, block_bytes=2000, bucket_rows=rows, most_splitters=splitters, outputs=("kept", "kept_sha256", "spans")).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    mine = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]
    assert sorted(mine, key=key) == sorted(brute(data), key=key)
    for r in got:
        assert sum(e - s for s, e in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed


def test_texts_stay_valid(spark):
    a = "é" * 60
    data = [(1, "x" + a), (2, "yz" + a + " tail ü"), (3, None), (3, None), (4, "unlike")]
    docs = spark.createDataFrame([(*r, "en") for r in data], "doc_id long, text string, lang string")
    out = without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "x" + a), (2, "yz tail ü"), (3, ""), (3, ""), (4, "unlike")]
    assert without_repeats(docs.limit(0)).count() == 0
