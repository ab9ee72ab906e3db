import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

import corpus_pipeline

from talkweave.llm.packing import ByteBpe

SIZE = 2048


def fixture():
    rng = random.Random(8)
    syl = ["an", "the", "on", "er", "ti", "re", "st", "ing", "ou"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randrange(1, 4)))
    say = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    shared, rows, toxic = " ".join(word() for _ in range(60)), [], set()
    for i in range(160):
        text = say(rng.randrange(2, 12))
        if i % 4 == 0:
            words = text.split(" ")
            for _ in range(3 + len(words) // 20):
                words.insert(rng.randrange(len(words)), "loz" + rng.choice(syl) + rng.choice(syl))
            text, toxic = " ".join(words), toxic | {i}
        elif i % 9 == 1:
            text += "\nread more on this page"
        elif i % 9 == 2:
            text += "\n" + shared + " " + word()
        rows.append((i, text))
    rows += [(200 + k, rows[5][1]) for k in range(4)]  # copies
    rows += [(210, rows[6][1] + " tail"), (220, "few words"), (221, None), (222, "a b c d e f " * 20), (223, "é" + rows[7][1])]
    rows += [(230 + k, f"own{k} line{k} here{k} it{k} is{k}\nread more on this page and then some more of it again\nshort{k}") for k in range(14)]
    return [(i, t, "en", "host", len(t or "")) for i, t in rows], toxic


def quality(rows):
    lines = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    key = lambda h, x: int(hashlib.md5(f"h{h}\n{' '.join(x.lower().split())}".encode()).hexdigest()[:15], 16)
    docs = defaultdict(set)
    for _, t, _, h, _ in rows:
        ks = tuple(key(h, x) for x in lines(t))
        for k in ks:
            docs[k].add(ks)  # copies of one text are one document
    gone = {k for k, own in docs.items() if len(own) > 10}
    out = []
    for i, t, lang, h, _ in rows:
        w = (t or "").split()
        win = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        spots = {k + j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(5)}
        cut = [x for x in lines(t) if key(h, x) in gone]
        left = len(w) - sum(len(x.split()) for x in cut)
        if len(w) < 10 or 100 * len(spots) > 20 * len(w) or cut and (left < 10 or 100 * left < 30 * len(w)):
            continue
        text = t if not cut else "\n".join(x for x in t.split("\n") if not x.strip() or key(h, x) not in gone)
        out.append((i, text, lang, h, len(text)))
    return out


def nearest(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, out = [shingles(t) for _, t, *_ in rows], []
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    for r in range(len(rows)):
        seen, todo = {r}, [r]
        while todo:
            a = todo.pop()
            new = [b for b in range(len(rows)) if b not in seen and near(sets[a], sets[b])]
            seen.update(new)
            todo += new
        if rows[r][0] == min(rows[b][0] for b in seen):
            out.append(rows[r])
    return out


def uncovered(rows, span=50):
    first = {}
    for i, t, *_ in rows:
        b = t.encode()
        for p in range(len(b) - span + 1):
            first[b[p : p + span]] = min(first.get(b[p : p + span], i), i)
    out = []
    for i, t, *rest in rows:
        b, gone = t.encode(), set()
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < i:
                gone.update(range(p, p + span))
        text = bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="ignore")
        out.append((i, text, *rest[:-1], len(text)))
    return out


def test_equals_brute_force(spark, tmp_path):
    rows, toxic = fixture()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(160) if i % 7], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, first), *rest = corpus_pipeline.STAGES
    clean = first(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    got = sorted(map(tuple, clean.collect()))
    left = {r[0] for r in got}
    assert len(toxic & left) <= 4 and len(left) >= len(rows) - len(toxic) - 4
    want = sorted(r for r in rows if r[0] in left)
    assert got == want
    for (_, stage), brute in zip(rest[:-1], (quality, nearest, uncovered), strict=True):
        clean = stage(spark, spark.createDataFrame(want, kind), str(tmp_path))
        assert clean.columns == docs.columns
        before, want = len(want), sorted(brute(want))
        assert sorted(map(tuple, clean.collect())) == want
        assert stage is rest[2][1] or len(want) < before
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    bpe = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {(i, s): (len(ids[s : s + SIZE]), zlib.crc32(ids[s : s + SIZE].tobytes()), len(ids)) for i, t, *_ in want for ids in [np.append(bpe.encode([t])[0], 1).astype("<u4")] for s in range(0, len(ids), SIZE)}
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in out} == pieces and len(out) == len(pieces)
    fill = defaultdict(list)
    for r in out:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= SIZE


CLASH = ("score", "predicted", "data", "id", "c0", "__row", "__removed", "__kept", "__lines", "__rid", "rid", "text_key", "key", "host", "row", "words", "component_id", "a.b", "q`t")


def test_hard_rows_and_clashing_names(spark, tmp_path):
    """Nulls in any column, repeated ids, genuine U+FFFD, long texts and columns named like the stages' own."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    shared, long = say(30), say(60_000)
    rows = [(1, say(40)), (1, say(41)), (2, None), (None, say(30)), (None, None), (3, ""), (4, long), (5, "\ufffd genuine " + shared), (6, say(12) + " \ufffd " + shared + " \ufffd é"), (7, say(30)), (8, "é" * 300)]
    rows.append((9, rows[9][1]))  # a copy of 7
    rows.append((8, rows[9][1]))  # and one that shares its id with another text
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASH)
    full = [(i, t, None, None if k % 2 else "h", None if t is None else len(t), *(f"{c}{k}" for c in CLASH)) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, kind).repartition(2)
    spark.createDataFrame([(1, 1), (7, 0), (9, None), (None, 1), (9, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = {r[0:2] + r[5:]: r for r in full}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert all(r[5:] in {x[5:] for x in full} for r in got) and len({r[5:] for r in got}) == len(got)
        if stage is corpus_pipeline.drop_toxic:
            assert got and all(r in full for r in got)
        if stage is corpus_pipeline.keep_quality:
            assert {r[5] for r in got} == {f"score{k}" for k in (0, 1, 3, 6, 7, 8, 9, 11, 12)} and all(r[:2] + r[5:] in own for r in got)
        if stage is corpus_pipeline.one_of_each:
            assert {r[5] for r in got} == {f"score{k}" for k in (0, 1, 2, 3, 6, 7, 8, 9, 10)}
        if stage is corpus_pipeline.cut_repeats:
            text = {r[5]: r[1] for r in got}
            assert len(got) == len(rows) and text["score2"] is None and text["score7"] == rows[7][1]
            assert text["score8"].count("\ufffd") == 2 and shared not in text["score8"] and text["score8"].endswith("\ufffd é")
            assert text["score11"] == "" and text["score10"] == rows[10][1]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
