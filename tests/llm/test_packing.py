import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talkweave.llm.packing import PLAIN_BELOW, ByteBpe, pack, plan_packs

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plan_fills_each_rank_once_and_never_overflows():
    rng = np.random.default_rng(1)
    for _ in range(20):
        hist = {int(k): int(rng.integers(1, 40)) for k in rng.integers(1, 65, 30)}
        rows = plan_packs(hist, 64)
        fill, seen = {}, {k: set() for k in hist}
        for length, rank, n, seq, packs, offset in rows:
            for i in range(n):
                seen[length].add(rank + i)
                fill.setdefault(seq + i % packs, []).append((offset + i // packs * length, length))
        assert all(seen[k] == set(range(v)) for k, v in hist.items())
        for parts in fill.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 64
        assert sorted(fill) == list(range(len(fill)))


def test_both_libraries_agree_on_every_plain_code_point():
    bpe = ByteBpe(PATH)
    assert bpe.fast is not None
    texts = [f"a{c}b {c}{d} {d}x1{c}  {c}\n{d}'s{c}" for c in map(chr, range(PLAIN_BELOW)) for d in ("a", " ", "1", "\n", "é", chr(0xA0), chr(0x85))]
    slow = [x.ids for x in bpe.slow.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encode(texts)] == slow


def test_packs_whole_documents(spark):
    rows = [(1, "hello world " * 3000, 5), (2, None, 1), (3, "", 2), (4, "short", 3), (4, "short", 3), (None, "你好 <|endoftext|>", 4), (7, "x" * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    out = pack(docs, PATH, size=128).collect()
    bpe = ByteBpe(PATH)
    want = {}
    for i, t, _ in rows:
        want.setdefault((i, tuple([*bpe.slow.encode(t or "", add_special_tokens=False).ids, 1])), []).append(1)
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length <= 128
    for (i, ids), n in want.items():
        own = sorted(by_doc[(i, len(ids))], key=lambda r: r.start)
        joined = [x for s in range(0, len(ids), 128) for r in own if r.start == s for x in r.ids][: len(ids) * len(n)]
        assert sorted(joined) == sorted(list(ids) * len(n))
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    crc = pack(docs, PATH, size=128, payload="crc32").collect()
    assert sorted(r.ids_crc32 for r in crc) == sorted(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in out)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs, PATH).count() == 0


@pytest.mark.parametrize("n", [1, 2047, 2048])
def test_one_length(n):
    rows = plan_packs({n: 5}, 2048)
    assert rows[:, 2].sum() == 5


def test_added_tokens_in_texts_keep_their_id():
    plain, bpe = Tokenizer.from_file(PATH), ByteBpe(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "é<|endoftext|>", "你好 <|endoftext|>", "<|endoftext|", "plain"]
    got = [x.tolist() for x in bpe.encode(texts)]
    assert got == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert plain.token_to_id("<|endoftext|>") in got[0] and len(got[0]) == 3
