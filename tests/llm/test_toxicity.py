import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from talkweave.llm.labelled import bounded_sample, fold_of
from talkweave.llm.toxicity import ORDER, PRIOR, Difference, fit, own_grams, read, score, shared_backoff


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    syl = ["an", "the", "on", "er", "ti", "re", "st", "ing", "ou"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(8, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words)), "loz" + rng.choice(syl) + rng.choice(syl))
        rows.append((i, " ".join(words), "x"))
        if i % 5:
            labels.append((i, int(toxic)))
    return rows, labels


def padded(text):
    low = "".join(" " if c in "\t\n\v\f\r" else c.lower() if c.isascii() else c for c in text or "")
    return b" " * (ORDER - 1) + low.encode()


def grams_of(text):
    b = padded(text)
    return [b[i : i + ORDER] for i in range(len(b) - ORDER + 1)]


def slow_backoff(texts):
    """p(last byte | those before) of shorter grams, by sets of what precedes them."""
    before, types = {}, {g for t in texts for g in grams_of(t)}
    while types and len(next(iter(types))) > 1:
        for g in types:
            before.setdefault(g[1:], set()).add(g[0])
        types = {g[1:] for g in types}
    follow = defaultdict(list)
    for g, own in before.items():
        follow[g[:-1]].append(len(own))

    def p(g):
        if not g:
            return 1 / 256
        n, low = follow.get(g[:-1]), p(g[1:])
        return low if n is None else max(len(before.get(g, ())) - 0.75, 0) / sum(n) + 0.75 * len(n) / sum(n) * low

    return p


def number(g):
    return int.from_bytes(g, "big")


def test_backoff_equals_brute_force(spark):
    rows, _ = corpus(n=40)
    texts = [t.title() for _, t, _ in rows[:30]] + ["Ééß ñ  \t\n naïve", "日本語 日本", "ab" * 400, None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, grams string").repartition(3)
    p = slow_backoff(texts)
    grams = {g[1:] for t in texts[:3] + texts[30:33] for g in grams_of(t)} | {g[1 - ORDER :] for g in (b"qqqqq", b"   qz", b"ababz")}
    wanted = sorted(grams, key=number)
    got = shared_backoff(docs, np.array([number(g) for g in wanted], dtype=np.uint64))
    assert np.allclose(got, [p(g) for g in wanted], rtol=1e-9) and len(wanted) > 200
    for context in (b" the"[2 - ORDER :], b"qqqq"[2 - ORDER :]):
        assert abs(sum(p(context + bytes([c])) for c in range(256)) - 1) < 1e-9


def test_differences_equal_brute_force():
    rows, _ = corpus(n=30)
    toxic, plain = [t for i, t, _ in rows if i % 4 == 0], [t for i, t, _ in rows if i % 4]
    p = slow_backoff(toxic + plain)
    counts = [Counter(g for t in own for g in grams_of(t)) for own in (plain, toxic)]

    def slow(g):
        out = []
        for n in counts:
            own = [k for h, k in n.items() if h[:-1] == g[:-1]]
            out.append(np.log((max(n[g] - 0.75, 0) + (0.75 * len(own) + PRIOR) * p(g[1:])) / (sum(own) + PRIOR)))
        return out[1] - out[0]

    every = sorted(set(counts[0]) | set(counts[1]), key=number)
    keys = np.array([number(g) for g in every], dtype=np.uint64)
    d = Difference(keys, np.array([[c[g] for c in counts] for g in every]), np.array([p(g[1:]) for g in every]))
    asked = every[::7] + [g[:-1] + b"~" for g in every[::31]] + [b"zzzzzz"[:ORDER]]
    got = d.of(np.array([number(g) for g in asked], dtype=np.uint64))
    assert np.allclose(got, [slow(g) for g in asked], atol=0.01, rtol=0.002) and got[-1] == 0  # half precision
    f = d.features([b"lozan", toxic[0].encode(), b""])
    assert np.isclose(f[1, 0], np.mean([slow(g) for g in grams_of(toxic[0])]), atol=0.01) and not f[2].any() and f[0, 0] > 0


def test_grams_of_texts_do_not_cross():
    g, doc = own_grams(*read([b"abc abd", b"", b"X\tyz"]))
    assert g.tolist() == [number(x) for t in ("abc abd", "x yz") for x in grams_of(t)] and doc.tolist() == [0] * 7 + [2] * 4


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    odd = [(None, "lozanan lozerer lozstst", "x"), (1000, None, "x"), (1001, "", "x"), (1002, rows[0][1] * 50, "x"), (1002, rows[0][1] * 50, "x")]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, score string").repartition(4)
    lab = spark.createDataFrame([*labels, (3, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    usable = fold_of("doc_id", 3) != 1
    got = score(docs, fit(docs, lab, usable), held_out=fold_of("doc_id", 3).isin(1, -1)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: i % 4 == 0 for i, _, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum((r.predicted == 1) == truth[r.doc_id] for r in held) >= 0.93 * len(held)
    assert len({r.score for r in got if r.doc_id == 1002}) == 1
    assert {r.score for r in score(docs, fit(docs, lab.limit(0), usable)).collect()} == {0.5}
    assert score(docs.limit(0), lambda t: np.zeros(len(t))).count() == 0


def test_sample_is_bounded_and_clean(spark):
    rows, labels = corpus(n=100)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    lab = spark.createDataFrame([*labels, (1, 1), (2, 7), (3, None)], "doc_id long, toxic int")
    got = bounded_sample(docs, lab, "toxic", fold_of("doc_id", 3) != 1, 9, 1 << 20).collect()
    assert [sum(r.label == c for r in got) for c in (0, 1)] == [9, 9]
    assert 1 not in {r.doc_id for r in got} and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(40)] + [(3, "y")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = bounded_sample(docs, lab, "toxic", fold_of("doc_id", 3) != 9, 30, 750).collect()
    assert all(sum(len(r.data) for r in got if r.label == c) <= 750 and sum(r.label == c for r in got) >= 7 for c in (0, 1))
    assert len({r.doc_id for r in got}) == len(got)


def test_few_labels_still_rank_and_predict(spark):
    rows, _ = corpus(seed=2, n=200)
    rows = [(i, t + " lozan lozer lozst lozing" * (1 + len(t) // 200) if i % 4 == 0 else t, x) for i, t, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    usable = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    few = [i for i in usable if i % 4 == 0][:6] + [i for i in usable if i % 4][:36]
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in few], "doc_id long, toxic int")
    got = score(docs, fit(docs, lab, fold_of("doc_id", 3) != 1)).collect()
    toxic, clean = ([r for r in got if (r.doc_id % 4 == 0) == t and r.doc_id not in few] for t in (True, False))
    assert sum(a.score > b.score for a in toxic for b in clean) >= 0.9 * len(toxic) * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.1 * len(clean)


def test_labels_of_absent_documents_take_no_room(spark):
    """Many labels of other ids beside those of the documents at hand: the sample and its bound are of these."""
    rows, labels = corpus(n=80)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = spark.createDataFrame(labels, "doc_id long, toxic int")
    more = own.unionByName(spark.range(1000, 40000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic"))
    usable = fold_of("doc_id", 3) != 1
    few = {tuple(r) for r in bounded_sample(docs, own, "toxic", usable, 12, 1 << 20).collect()}
    assert {tuple(r) for r in bounded_sample(docs, more, "toxic", usable, 12, 1 << 20).collect()} == few and len(few) > 16
    texts = [t.encode() for _, t, _ in rows]
    assert len(set(np.round(fit(docs, more, usable)(texts), 6))) > 40
