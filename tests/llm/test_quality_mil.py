import math
import random
import zlib

import numpy as np

from talkweave.llm.labelled import fold_of
from talkweave.llm.quality_mil import WIDTH, Attention, fit, passages
from talkweave.llm.toxicity import score


def test_passages():
    texts = [b"", b"one", b"a b c " * 30, b" \n ", "é! ".encode() * 41]
    x, bag = passages(texts)
    assert x.shape == (len(bag), WIDTH) and np.isfinite(x).all()
    assert np.bincount(bag).tolist() == [1, 1, 3, 1, 2]
    alone = np.concatenate([passages([t])[0] for t in texts])
    assert np.allclose(x, alone)


def test_gradients():
    g = np.random.default_rng(0)
    m = Attention(width=5, hidden=4, gate=3)
    x, starts, y, w = g.normal(size=(9, 5)), np.array([0, 2, 3]), np.array([1.0, 0, 1]), np.array([0.5, 1, 2])
    _, grad = m.gradients(x, starts, y, w)
    for k, v in m.p.items():
        i = np.unravel_index(g.integers(v.size), v.shape)
        keep = v[i]
        v[i] = keep + 1e-5
        up, _ = m.gradients(x, starts, y, w)
        v[i] = keep - 1e-5
        down, _ = m.gradients(x, starts, y, w)
        v[i] = keep
        assert abs((up - down) / 2e-5 - grad[k][i]) < 1e-5


def test_scores_equal_a_loop_over_passages():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "C,", "d9", "###", "é"]) for _ in range(n)).encode() for n in (0, 3, 41, 500)]
    m = Attention(seed=2)
    m.mean, m.scale = np.random.default_rng(1).normal(size=(2, WIDTH)) ** 2 + 0.1
    got = m.score(texts)
    for text, score_ in zip(texts, got, strict=True):
        weights, encoded = [], []
        for row in passages([text])[0]:
            z = [max(-6.0, min(6.0, (float(v) - mean) / scale)) for v, mean, scale in zip(row, m.mean, m.scale, strict=True)]
            h = [math.tanh(sum(z[i] * m.p["E"][i][j] for i in range(WIDTH)) + m.p["e"][j]) for j in range(len(m.p["e"]))]
            gate = [math.tanh(sum(h[i] * m.p["V"][i][j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * m.p["U"][i][j] for i in range(len(h))))) for j in range(len(m.p["w"]))]
            weights.append(math.exp(sum(a * b for a, b in zip(gate, m.p["w"], strict=True))))
            encoded.append(h)
        mean = [sum(w * h[j] for w, h in zip(weights, encoded, strict=True)) / sum(weights) for j in range(len(encoded[0]))]
        assert abs(score_ - 1 / (1 + math.exp(-(sum(a * b for a, b in zip(mean, m.p["c"], strict=True)) + m.p["b"][0])))) < 1e-9


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "the", "on", "er", "ti"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(20, 300))]
        bad = i % 3 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at : at + 40] = [rng.choice(words) + "###" for _ in range(30)]
        rows.append((i, " ".join(words), 0.1))
        labels.append((i, int(not bad)))
    odd = [(None, "a b", 0.1), (1000, None, 0.1), (1001, "", 0.1), (1002, rows[0][1] * 40, 0.1), (1002, rows[0][1] * 40, 0.1)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    got = score(docs, fit(docs, lab, fold_of("doc_id", 5) != 0), 0.3, held_out=fold_of("doc_id", 5).isin(0, -1)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum((r.predicted == 1) == (r.doc_id % 3 != 0) for r in held) >= 0.93 * len(held)
    assert len({r.score for r in got if r.doc_id == 1002}) == 1
    assert {r.score for r in score(docs, fit(docs, lab.limit(0), fold_of("doc_id", 5) != 0), 0.3).collect()} == {0.5}
