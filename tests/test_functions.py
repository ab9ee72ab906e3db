import pytest
import zstandard
from pyspark.sql import functions as F

from talkweave import schema as S
from talkweave.functions import content, labels, text, wire, xmltext
from talkweave.functions.stemmer import stem
from talkweave.functions.tokens import Options, phrases, tokenize, tokens


def one(spark, c, **values):
    d = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return d.select(c).first()[0]


def field(tag, kind, value):
    n = lambda x: bytes([x]) if x < 128 else bytes([x & 127 | 128, x >> 7])
    return n(tag << 3 | kind) + (n(value) if kind == 0 else n(len(value)) + value)


def test_codes(spark):
    assert one(spark, labels.msg_type(F.lit(244813135921)), x=1) == 49
    assert one(spark, labels.sub_type(F.lit(244813135921)), x=1) == 57
    assert one(spark, labels.msg_sub_type_label(F.lit(49), F.lit(36)), x=1) == "mini_program"
    assert one(spark, labels.msg_sub_type_label(F.lit(49), F.lit(999)), x=1) == "app"
    assert one(spark, labels.msg_sub_type_label(F.lit(3), F.lit(5)), x=1) == "image"
    assert one(spark, labels.app_display_label(F.lit(77)), x=1) == "app type=77"
    assert [labels.parse_msg_type(x) for x in ("Text", "49", "+3", "-1", "nope", "4294967296", None)] == [1, 49, 3, None, None, None, None]
    assert len(S.APP_SUB_TYPES) == 41


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ("<a><title>T &amp;lt; x</title></a>", "T < x"),
        ("<title><![CDATA[A<B &amp; C]]></title>", "A<B & C"),
        ("<title></title><title>later</title>", None),
        ("<title>open", None),
        ("none", None),
        ("<title>line\nend</title>", "line\nend"),
        ("<title><![CDATA[]]></title>", None),
        ("<title><![CDATA[open</title>", "<![CDATA[open"),
    ],
)
def test_tag_text(spark, xml, want):
    assert one(spark, xmltext.tag_text(F.col("x"), "title"), x=xml) == want


def app(sub, xml, **more):
    return {"msg_type": 49, "sub_type": sub, "body": xml, **more}


CASES = [
    ({"msg_type": 1, "sub_type": 0, "body": "hi"}, "Text", {"text": "hi"}, "hi", ["hi"], "hi"),
    (app(5, "<title>null</title><des>null</des><url>null</url>"), "Link", {"title": None, "des": None, "url": "null"}, "[链接] ", [], "null\nnull"),
    (app(51, "<title></title><des>d</des>"), "ChannelVideo", {"title": "d", "des": None}, "[视频号] d", ["d"], "d"),
    (app(6, "<title>f.txt</title><fileext>txt</fileext><totallen>12x</totallen><md5>abc</md5>"), "File", {"file_ext": "txt", "file_size": None, "md5": "abc"}, "[文件] f.txt", ["f.txt"], "f.txt"),
    (
        app(57, "<title>re</title><refermsg><type>49</type><chatusr>c1</chatusr><fromusr>f1</fromusr><displayname>Dora</displayname><content>&lt;appmsg&gt;&lt;title&gt;inner&lt;/title&gt;</content></refermsg>"),
        "Quote",
        {"reply_text": "re", "refer_sender": "Dora", "refer_content": "inner", "refer_type": 49},
        "[引用 @Dora: inner] re",
        ["re", "inner"],
        "re inner",
    ),
    (app(57, "<title>re</title><refermsg><type>3</type><fromusr>f1</fromusr><content>&lt;img/&gt;</content></refermsg>"), "Quote", {"refer_sender": "f1", "refer_content": "[图片]"}, "[引用 @f1: [图片]] re", ["re", "[图片]"], "re [图片]"),
    (app(57, "<title>re</title>"), "Quote", {"refer_sender": None}, "[引用] re", ["re"], "re"),
    (app(2000, "<wcpayinfo><feedesc>1.00</feedesc><paysubtype>3</paysubtype></wcpayinfo>"), "Transfer", {"amount_desc": "1.00", "pay_sub_type": 3}, "[转账] 1.00", ["1.00"], "1.00"),
    (app(62, "<x/>"), "Pat", {"raw_xml": "<x/>"}, "[拍一拍]", [], None),
    (app(77, "<title>t</title>"), "AppGeneric", {"sub_type": 77, "title": "t"}, "[app type=77] t", ["t"], "t"),
    (app(2003, "<title>gift</title>"), "RedEnvelope", {"title": "gift", "sub_type": None}, "[红包] gift", ["gift"], "gift"),
    ({"msg_type": 10000, "sub_type": 0, "body": '<sysmsg type="revokemsg"><revokemsg><content>gone</content></revokemsg></sysmsg>'}, "System", {"text": "gone"}, "[system] gone", ["gone"], None),
    ({"msg_type": 10000, "sub_type": 0, "body": "plain"}, "System", {"text": "plain"}, "[system] plain", ["plain"], None),
    ({"msg_type": 999, "sub_type": 0, "body": "raw"}, "Unknown", {"text": "raw", "unknown_type": 999}, "[type=999]", ["raw"], "raw"),
    ({"msg_type": 34, "sub_type": 0, "body": "x"}, "Voice", {"text": None}, "[voice]", [], None),
]


def test_contents(spark):
    rows = [(k, c["msg_type"], c["sub_type"], c["body"]) for k, (c, *_) in enumerate(CASES)]
    d = content.with_content(spark.createDataFrame(rows, "k int, msg_type long, sub_type long, body string"), "body")
    k, c = F.col("content_kind"), F.col("content")
    got = d.select("k", k, c, content.snippet(k, c).alias("snippet"), content.searchable(k, c).alias("words"), content.index_text(k, c).alias("indexed")).orderBy("k").collect()
    for r, (_, kind, fields, snippet, words, indexed) in zip(got, CASES, strict=True):
        assert (r.content_kind, r.snippet, r.words, r.indexed) == (kind, snippet, words, indexed)
        assert {f: r.content[f] for f in fields} == fields


def test_group_texts(spark):
    sender, body = text.group_sender(F.col("t"), F.col("x"), F.lit("fall"))
    d = spark.createDataFrame([("g@chatroom", "bob:\nhi:\nyou"), ("g@chatroom", "plain"), ("p", "bob:\nhi"), ("g@chatroom", ":\nempty")], "t string, x string")
    assert [tuple(r) for r in d.select(sender, body).collect()] == [("bob", "hi:\nyou"), ("fall", "plain"), ("fall", "bob:\nhi"), ("", "empty")]
    d = spark.createDataFrame([("g@chatroom", "id:\nhello"), ("g@chatroom", "a b:\nx"), ("p", "id:\nx"), ("g@chatroom", "none")], "t string, x string")
    assert [r[0] for r in d.select(text.group_summary(F.col("t"), F.col("x"))).collect()] == ["hello", "a b:\nx", "id:\nx", "none"]


def test_names_and_small_functions(spark):
    assert one(spark, text.display_with_id(F.lit("Ann"), F.lit("u1")), x=1) == "Ann（u1）"
    assert one(spark, text.display_with_id(F.lit("u1"), F.lit("u1")), x=1) == "u1"
    assert one(spark, text.session_direction(F.lit("  "), "me"), x=1) is None
    assert one(spark, text.session_direction(F.lit(" me "), "me"), x=1) == "outgoing"
    assert one(spark, text.cjk_split(F.col("x")), x="你好world 测试") == "你 好 world 测 试"
    assert one(spark, text.cjk_split(F.col("x")), x="a测b") == "a 测 b"
    assert text.index_query('你好 he"y') == '"你 好" AND "he""y"' and text.index_query("  ") == ""
    assert one(spark, text.safe_filename(F.col("x")), x="a b/c-é_测.t") == "a_b_c-é_测.t"
    assert one(spark, text.short_date(F.lit(1704240000)), x=1) == "2024-1-3"
    assert one(spark, text.shard_id(F.lit("/x/message_12.db")), x=1) == 12
    assert one(spark, text.media_type(F.col("x")), x=bytearray(b"RIFF0000WEBPxx")) == "webp"
    assert one(spark, text.media_type(F.col("x")), x=bytearray(b"\xff\xd8\xff\x00")) == "jpg"
    assert [one(spark, text.is_month_dir(F.lit(m)), x=1) for m in ("2024-01", "2024-13", "24-01")] == [True, False, False]
    assert one(spark, text.table_name(F.lit("a")), x=1) == "Msg_0cc175b9c0f1b6a831c399e269772661"


def test_wire():
    md5 = "0123456789abcdef" * 2
    assert wire.packed_md5(field(3, 2, field(4, 2, md5.encode()))) == (md5, None)
    assert wire.packed_md5(b"\xff\xff") == (None, None) == wire.packed_md5(None)
    room = field(1, 2, field(1, 2, b"u1") + field(2, 2, b"Ann")) + field(1, 2, field(1, 2, b"u2"))
    assert wire.room_members(room) == [("u1", "Ann"), ("u2", None)] and wire.room_members(room[:-1]) == []
    phone = field(14, 2, field(1, 0, 1) + field(2, 2, field(1, 2, b"555")))
    full = field(2, 0, 1) + field(5, 2, b"CN") + field(7, 2, b"SZ") + phone + field(30, 2, b"5, 6,,")
    assert wire.contact_extra(full) == {"gender": 1, "signature": None, "region": "CN · SZ", "source_scene": None, "phone": "555", "label_ids": ["5", "6"]}
    assert wire.contact_extra(field(14, 2, field(1, 0, 0) + field(2, 2, field(1, 2, b"555"))))["phone"] is None
    assert wire.resource_md5(b"xx\x12\x22\x0a\x20" + md5.encode()) == md5
    assert wire.resource_md5(b"\x12\x22\x0a\x20" + md5.upper().encode() + b"." + md5.encode()) == md5  # upper case is no digest
    assert wire.resource_md5(b"zz" + md5.encode()) == md5 and wire.resource_md5(b"a-" + md5.encode()) is None


def test_decode_content(spark):
    packed = zstandard.ZstdCompressor().compress("héllo".encode())
    rows = [(bytearray(b"plain"), None), (bytearray(packed), 4), (bytearray(packed), None), (bytearray(b"\x28\xb5\x2f\xfd\xff\xff\xff"), None), (bytearray(b"a\xffb"), 0), (bytearray(b"zz"), 4)]
    d = spark.createDataFrame(rows, "b binary, ct int")
    assert [r[0] for r in d.select(wire.decode_content(F.col("b"), F.col("ct"))).collect()] == ["plain", "héllo", "héllo", None, "a�b", None]


def test_stems():
    pairs = "running run|flies fli|happily happili|generously generous|relational relat|hopping hop|hoping hope|skies sky|caresses caress|agreed agre|consigned consign|knightly knight|controlling control|national nation|news news|ties tie|dies die|cries cri|by by|say say|yes yes|communism communism|proceed proceed|ability abil|kindness kind"
    for p in pairs.split("|"):
        word, want = p.split()
        assert stem(word) == want, word


def test_tokens():
    assert tokenize("Running 42 iPhone!") == [["run", "running"], ["iphon", "iphone"]]
    assert tokenize("你好，ab。") == [["你"], ["好"], ["，"], ["ab"]]
    assert tokenize("a1 @b", Options(numbers=True, symbols=True)) == [["a"], ["1"], ["@"], ["b"]]
    assert phrases("@ user") == [[], [["user"]]] and phrases(" ") == []
    assert Options.parse(["enable_num_token", "other"]) == Options(numbers=True)


@pytest.mark.parametrize("names", [[], ["enable_num_token"], ["enable_special_char"], ["enable_num_token", "enable_special_char"]])
def test_built_in_tokens_equal_python(spark, names):
    options = Options.parse(["skip_stemming", *names])
    texts = ["", None, "Running 42 iPhone! x_y", "你好，ab。 — «É» ß12", "a\tb\x00c\x7fd", "🙂🙂 mixedCASE \u3000\u2014[~`^]{}", "ABC aBc"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.x for r in d.select("k", tokens(F.col("t"), options).alias("x")).orderBy("k").collect()]
    assert got == [tokenize(t, options) for t in texts]


def test_tags_once_evaluated(spark):
    cases = {
        r"<title><![CDATA[a $1 \ <b>]]></title>": r"a $1 \ <b>",
        "<title><![CDATA[]]></title>": None,
        "<title></title>": None,
        "<title>a &amp;lt; b</title>": "a < b",
        "<title> <![CDATA[x]]></title>": " <![CDATA[x]]>",
        "<title>one</title><title>two</title>": "one",
        "<title>open": None,
        "": None,
    }
    d = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "xml string, want string")
    assert d.filter(~xmltext.tag_text(F.col("xml"), "title").eqNullSafe(F.col("want"))).count() == 0
    numbers = {"7": 7, "+7": 7, "": None, "-1": None, "7a": None, "4294967295": 4294967295, "4294967296": None, "9" * 40: None, None: None}
    d = spark.createDataFrame(list(numbers.items()), "n string, want long")
    assert d.filter(~xmltext.unsigned(F.col("n"), 2**32 - 1).eqNullSafe(F.col("want"))).count() == 0


def test_all_kinds_of_bodies_compile(spark):
    """No stage of decoding, rendering or indexing falls back to interpreted expressions."""
    from talkweave.functions import content
    from talkweave.plans.bodies import CODES

    quote = "<msg><appmsg><title>re &amp; re</title><des>d</des><refermsg><type>49</type><chatusr>u</chatusr><displayname>U</displayname><content>&lt;appmsg&gt;&lt;title&gt;inner&lt;/title&gt;</content></refermsg></appmsg></msg>"
    d = spark.createDataFrame([(c & 0xFFFFFFFF, c >> 32, quote) for c in CODES], "msg_type long, sub_type long, body string").repartition(2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.fallback", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        k, c = F.col("content_kind"), F.col("content")
        got = content.with_content(d, "body").select(k, content.snippet(k, c).alias("s"), content.index_text(k, c).alias("i"), content.searchable(k, c).alias("t"), xmltext.quote_sender(F.col("content.raw_xml")).alias("q")).collect()
    finally:
        for key, v in before.items():
            spark.conf.set(key, v)
    rows = {r.content_kind: r for r in got}
    assert len(got) == len(CODES) and rows["Quote"].s == "[引用 @U: inner] re & re" and rows["Quote"].i == "re & re inner" and rows["Quote"].t == ["re & re", "inner"] and rows["Quote"].q == "u"
    assert rows["Link"].i == "re &amp; re\nd" and rows["Pat"].i is None
