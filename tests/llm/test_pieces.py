import hashlib
from array import array

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from talkweave.llm.piece_codec import MARK, Codec, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
CODEC = Codec(PATH)
HARD = ["", " ", "   ", "a", " a", "a  ", f"a{MARK}b", f"{MARK}", f"{MARK}{MARK} x", "\n\n\t x", "<s> </s> <unk> <0x0A>", "你好 wörld 🙂🙂", "\x00\x01", "aaaa" * 50, "a b" * 500, "�", "1234567 89", "é" * 40 + " " * 40 + "x", "́́a"]


def test_equals_library_on_hard_texts():
    for t in HARD:
        ((got, same),) = CODEC.encode([t], True)
        assert same
        ids, back = got.tolist(), CODEC.decode(got)
        assert ids == CODEC.v.library.encode(t), t
        assert CODEC.ids_text(got) == ",".join(map(str, ids))
        assert back == CODEC.v.library.decode(ids) == CODEC.v.decode(ids), t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aeinorst  \n.,é1" + MARK)), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_equals_library(t):
    ((got, same),) = CODEC.encode([t], True)
    assert same
    ids, back = got.tolist(), CODEC.decode(got)
    assert ids == CODEC.v.library.encode(t)
    assert back == CODEC.v.library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 400), max_size=12))
def test_decodes_any_ids(ids):
    assert CODEC.v.decode(ids) == CODEC.decode(array("i", ids)) == CODEC.v.library.decode(ids)


def test_query_and_round_trip(spark):
    rows = [(i, t, 0) for i, t in enumerate(HARD)] + [(None, None, 1), (3, "a", 1), (90, "word " * 20000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = encode(docs, PATH, outputs=("ids", "ids_sha256", "decoded", "decoded_sha256"))
    got = out.collect()
    assert len(got) == len(rows) and all(r.agrees for r in got)
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert sorted(r.text for r in decode(out, PATH).collect()) == sorted(r.decoded for r in got)
    assert encode(docs.limit(0), PATH).count() == 0


def test_shared_agenda_equals_heap():
    words = sorted({w for t in HARD for w in CODEC.split(MARK + t.replace(" ", MARK))} | {"▁internationalisation", "tttttttt", "▁" * 9, "ab\x00cd"})
    assert [array("i", b).tolist() for b in CODEC.v.encode_words(words)] == [CODEC.v.encode_word(w) for w in words]


def test_a_wrong_word_is_told():
    codec = Codec(PATH)
    right = codec.v.encode_words
    codec.v.encode_words = lambda ws: [b if w != "▁bad" else array("i", [300]).tobytes() for w, b in zip(ws, right(ws), strict=True)]
    assert [s for _, s in codec.encode(["good one", "a bad one", ""], True)] == [True, False, True]


def test_whole_documents_agree(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    assert all(r.agrees for r in encode(docs, PATH, check="documents").collect())
