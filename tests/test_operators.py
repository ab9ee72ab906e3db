import hashlib
import json
import sqlite3

import pytest
import zstandard
from pyspark.sql import functions as F

from talkweave import schema as S
from talkweave.functions.content import with_content
from talkweave.functions.tokens import Options, tokenize, tokens
from talkweave.operators import export, media, people, privacy, resolve, search, timeline
from talkweave.operators import messages as M
from talkweave.page import effective_limit
from talkweave.sources import manifest
from talkweave.sources import sqlite_files as Q
from talkweave.sources.settings import Settings
from talkweave.store import ChatStore, ascending, shown, write_messages

KIND = "sort_seq long, server_id long, create_time long, talker string, sender string, msg_type long, sub_type long, body string"


def messages(spark, rows):
    d = with_content(spark.createDataFrame(rows, KIND).repartition(3), "body")
    return d.withColumn("status", F.lit(0)).select(*(F.col(f.name).cast(f.dataType) for f in S.MESSAGE.fields)).cache()


def text_row(seq, sid, t, talker="a", sender="b", body=None):
    return (seq, sid, t, talker, sender, 1, 0, body or f"msg-{seq // 100}")


@pytest.fixture(scope="module")
def anchors(spark):
    rows = [(100, 1001, 100), (200, 1002, 200), (300, 1003, 300), (300, 1004, 301), (500, 1005, 500), (600, 1006, 10100), (700, 1007, 10200), (800, 1008, 10300)]
    return messages(spark, [text_row(*r) for r in rows] + [text_row(400, 9, 1, talker="other")]).cache()


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({"after_sort_seq": 300, "limit": 100}, [500, 600, 700, 800]),
        ({"after_sort_seq": 100, "limit": 2}, [200, 300]),
        ({"after_sort_seq": 100, "keyword": "MSG-5", "limit": 100}, [500]),
        ({"around_sort_seq": 500, "context": 2}, [300, 300, 500, 600, 700]),
        ({"around_sort_seq": 300, "context": 1}, [200, 300, 300, 500]),
        ({"around_sort_seq": 500, "context": 3}, [200, 300, 300, 500, 600, 700, 800]),
        ({"around_sort_seq": 100, "context": 2}, [100, 200, 300]),
        ({"around_server_id": 1005, "context": 2}, [300, 300, 500, 600, 700]),
        ({"around_server_id": 1003, "context": 1}, [200, 300, 300]),
        ({"around_server_id": 9999}, []),
        ({"around_server_id": 1006, "context": 2}, [300, 500, 600, 700, 800]),
        ({"limit": 3}, [800, 700, 600]),
        ({"offset": 1, "limit": 2, "ascending": True}, [200, 300]),
        ({"offset": 2**31 - 1001}, []),
        ({"since": 200, "until": 500, "ascending": True}, [200, 300, 300, 500]),
    ],
)
def test_pages_and_anchors(anchors, how, want):
    assert [r.sort_seq for r in M.page(anchors, M.MessageQuery(talker="a", **how)).collect()] == want


def test_bulk_context_equals_single(spark, anchors):
    pivots = spark.createDataFrame([("a", 500), ("a", 300), ("a", 100), ("a", 450), ("other", 400), ("none", 1)], "talker string, pivot_seq long")
    got = M.around_many(anchors.select("talker", *M.KEY), pivots, 2).collect()
    for t, p in [("a", 500), ("a", 300), ("a", 100), ("a", 450), ("other", 400), ("none", 1)]:
        one = M.page(anchors, M.MessageQuery(talker=t, around_sort_seq=p, context=2)).collect()
        assert sorted(r.server_id for r in got if (r.talker, r.pivot_seq) == (t, p)) == sorted(r.server_id for r in one)


@pytest.mark.parametrize("bad", [{"around_sort_seq": 1, "after_sort_seq": 2}, {"around_sort_seq": 1, "since": 5}, {"after_sort_seq": 1, "offset": 2}, {"limit": -1}])
def test_parameters_are_checked(anchors, bad):
    with pytest.raises(ValueError, match="anchor|most one|negative"):
        M.page(anchors, M.MessageQuery(talker="a", **bad))


def test_limits_and_lenient_parameters():
    assert [effective_limit(x) for x in (0, 5, 99999)] == [1000, 5, 20000]
    assert [ascending(x) for x in ("ASC", "desc", "odd", None)] == [True, False, False, False]
    assert [shown(x) for x in ("1", "true", True, "yes", None, False)] == [True, True, True, False, False, False]


def test_watermarks(spark, anchors):
    ses = spark.createDataFrame([("a",), ("silent",)], "username string")
    assert {tuple(r) for r in M.max_seq(anchors, ses).collect()} == {("a", 800), ("silent", 0)}
    assert M.watermark(anchors, ses).first()[0] == 800
    assert M.watermark(anchors, ses.limit(0)).first()[0] == 0


CONTACTS = [("alice", "", "", "Alice", None, []), ("bob", "al2", "Bobby", "Bob", "met in Oslo", []), ("tagged", "", "", "Tag", None, ["Sensitive"]), ("user007", "", "", "James", None, ["Work"])]


def contacts(spark):
    d = spark.createDataFrame(CONTACTS, "user_name string, alias string, remark string, nick_name string, memo string, labels array<string>")
    return d.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("phone", "string"), ("signature", "string"), ("region", "string"), ("avatar_url", "string"), ("gender", "long"), ("source_scene", "long"))))


QUOTE = "<title>re</title><refermsg><type>1</type><chatusr>tagged</chatusr><displayname>Tag</displayname><content>secret</content></refermsg>"


def store(spark):
    t = 1700000000
    rows = [
        (1, 11, t + 1, "alice", "alice", 1, 0, "hello from alice"),
        (2, 12, t + 2, "bob", "me", 1, 0, "Running to bob"),
        (3, 13, t + 3, "tagged", "tagged", 1, 0, "private talk"),
        (4, 14, t + 4, "g@chatroom", "tagged", 1, 0, "hidden in group"),
        (5, 15, t + 5, "g@chatroom", "bob", 49, 57, QUOTE),
        (6, 16, t + 6, "g@chatroom", "me", 1, 0, "open words"),
        (7, 17, t + 7, "stranger", "x", 1, 0, "no session"),
    ]
    ses = spark.createDataFrame([("alice", t + 300, "hi", 1, "alice", None), ("bob", t + 200, "yo", 1, "me", None), ("g@chatroom", t + 100, "sum", 1, "tagged", "Tag"), ("tagged", t + 50, "p", 1, "tagged", None)], S.SESSION)
    return ChatStore(messages(spark, rows), ses, contacts(spark), None, "me", Settings([], ["Sensitive"]))


def test_privacy(spark):
    s = store(spark)
    assert [r.id for r in s.hidden().collect()] == ["tagged"]
    page = s.list_sessions().to_dict()
    assert [x["username"] for x in page["items"]] == ["alice", "bob", "g@chatroom"]
    assert page["paging"]["total"] == 3 and page["stats"]["scanned"] == 4
    room = page["items"][2]
    assert room["summary"] == S.HIDDEN_SUMMARY and "last_msg_sender" not in room and "direction" not in room
    assert s.list_sessions(show_hidden=True).to_dict()["items"][2]["summary"] == "sum"
    got = s.history("g@chatroom", order="asc").items.collect()
    assert [r.server_id for r in got] == [15, 16]
    assert got[0].snippet == "[引用] re" and got[0].content.raw_xml == "" and got[0].content.refer_content is None
    assert [r.server_id for r in s.history("g@chatroom", order="asc", show_hidden=True).items.collect()] == [14, 15, 16]
    assert s.history("g@chatroom").total == 3
    with pytest.raises(resolve.NotFound, match='contact "tagged" not found'):
        s.history("tagged")
    assert s.history("tagged", show_hidden=True).items.count() == 1
    assert s.media("g@chatroom", 14).count() == 0


def test_resolve(spark):
    c, hidden = contacts(spark), spark.createDataFrame([("tagged",)], "id string")
    ask = lambda name, **k: resolve.resolve(c, name, hidden, **k)
    assert ask("wxid_any").display_name is None and ask("x@chatroom").user_name == "x@chatroom"
    assert ask("alice").display_name == "Alice" and ask("user007").display_name == "James"
    assert ask("nobody99").user_name == "nobody99"
    assert ask("oslo").user_name == "bob" and ask("Work").user_name == "user007"
    assert ask("james").user_name == "user007"
    for bad in ("  ", "nothing", "Sensitive"):
        with pytest.raises(resolve.NotFound):
            ask(bad)
    with pytest.raises(resolve.Ambiguous, match="alice"):
        ask("al")
    assert ask("Sensitive", show_hidden=True).user_name == "tagged"


def test_resolve_all_says_what_resolve_says(spark):
    c, hidden = contacts(spark), spark.createDataFrame([("tagged",), ("gone@chatroom",)], "id string")
    asked = ["wxid_any", "x@chatroom", "gone@chatroom", "filehelper", "alice", "user007", "nobody99", "tagged", "oslo", "Work", "james", "  ", "", "nothing", "Sensitive", "al", "AL", "a", "é", "zz", "Alice ", "%", "filehelper"]
    for show in (False, True):
        want = {}
        for a in asked:
            try:
                r = resolve.resolve(c, a, hidden, show_hidden=show)
                want[a] = ("found", r.user_name, r.display_name)
            except (resolve.NotFound, resolve.Ambiguous) as e:
                want[a] = ("not found" if isinstance(e, resolve.NotFound) else "ambiguous", None, None)
        got = resolve.resolve_all(c, spark.createDataFrame([(a,) for a in [*asked, None]], "asked string"), hidden, show).collect()
        assert {r.asked: (r.outcome, r.user_name, r.display_name) for r in got} == want and len(got) == len(want)
    assert resolve.resolve_all(c, spark.createDataFrame([], "asked string")).count() == 0


def test_timeline(spark):
    s = store(spark)
    t = 1700000000
    got = s.timeline(t, t + 100, order="asc").items.collect()
    assert [r.server_id for r in got] == [11, 12, 15, 16]
    assert got[1].direction == "outgoing" and got[0].sender_display_name == "Alice（alice）"
    assert [r.server_id for r in s.timeline(t, t + 100, limit=2).items.collect()] == [16, 15]
    assert s.timeline(t, t + 100, type="nonsense").total == 4
    with pytest.raises(ValueError, match="since"):
        timeline.timeline(s.messages, s.sessions, 5, 4)


def test_search_modes(spark):
    s = store(spark)
    assert [r.server_id for r in s.search("WORDS").items.collect()] == [16]
    assert s.search("no session").total == 0
    s.build_index()
    hit = s.search("run bob")
    assert [r.server_id for r in hit.items.collect()] == [12] and hit.scanned == 0
    assert s.search("ran").total == 0 and s.search(" ").total == 0 and s.search("@").total == 0
    assert s.search("secret").total == 1 and s.search("private", hide=True).total == 0
    texts = spark.createDataFrame([(1, "你好world 测试"), (2, "user @user iPhone phones"), (3, "好你"), (4, "")], "k int, t string")
    d = texts.withColumn("tokens", tokens(F.col("t")))
    find = lambda q: sorted(r.k for r in search.phrase_search(d, q).collect())
    assert find("你好") == [1] and find("好") == [1, 3] and find("@user") == [2] and find("iphone") == [2] and find("phone") == [2]
    assert find("[") == [] and find("*") == []
    assert search.phrase_search(d, "1", options=Options(numbers=True)).count() == 0


def test_index_equals_tokens_of_rows(spark):
    rows = [text_row(k, k, k, body=b) for k, b in enumerate(["to be or not to be", "be to be", "to be", "or not", "not to be to be or", "be"])]
    d = messages(spark, rows)
    docs, postings = search.build_index(d)
    by_row = d.withColumn("tokens", tokens(F.col("content.text")))
    for q in ("to", "to-be", "be-to-be", "not or", "to-be or-not", "zzz"):
        want = sorted(r.server_id for r in search.phrase_search(by_row, q).collect())
        assert sorted(r.server_id for r in search.indexed_search(docs, postings, q).collect()) == want


def test_index_segments_follow_edits_and_recalls(spark, tmp_path):
    at, exact = str(tmp_path), Options(stemming=False)
    row = lambda k, month, body: text_row(k, k, 1700000000 + month * 2629800, body=body)
    rows = [row(k, k % 4, f"find me {k}") for k in range(1, 41)]
    find = lambda rows, q="find", **how: search.indexed_search(*search.stored_index(messages(spark, rows), at, exact, **how), q, exact).count()
    held = lambda: {r.month: r.segment for r in search.manifest(spark, f"{at}/{next(tmp_path.iterdir()).name}") if r.month}
    assert search.read_index(spark, at, exact) is None
    assert find(rows) == 40 and find(rows) == 40
    first = held()
    assert len(first) == 4 and len(set(first.values())) == 1
    edited = [row(k, k % 4, "new words" if k % 4 == 1 else f"find me {k}") for k in range(1, 41)]  # same ids
    assert find(edited) == 30 and find(edited, "new-words") == 10
    second = held()
    assert sum(first[m] != second[m] for m in first) == 1  # the other months were not indexed again
    assert find(edited[:-1]) == 29 and sum(second[m] != s for m, s in held().items()) == 1  # a recall
    assert find([*edited, row(99, 9, "find me, too")]) == 31 and len(held()) == 5
    assert find([r for r in edited if not str(r[-1]).count("new")], "new") == 0 and find([]) == 0
    assert find(rows) == 40 and find(edited, most_segments=1) == 30 and len(set(held().values())) == 1  # merged
    assert search.indexed_search(*search.read_index(spark, at, exact), "new", exact).count() == 10


def test_stems_come_from_a_table_of_words(spark):
    d = messages(spark, [text_row(k, k, k, body=b) for k, b in enumerate(["running runs run", "the run", "runner", "跑 Running", "generous"], 1)])
    docs, postings = search.build_index(d)
    want = {(r.server_id, p, t) for r in d.collect() for p, own in enumerate(tokenize(r.content.text)) for t in own}
    got = postings.join(docs.select("doc", "server_id"), "doc").select("server_id", "pos", "token").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_history_counts_the_keyword(spark):
    s = store(spark)
    assert s.history("alice", keyword="no such word").total == 1
    assert s.history("alice", keyword="no such word", count_filtered=True).total == 0


def test_exports_and_files_of_media(spark):
    s = store(spark)
    own = s.messages.filter("talker = 'alice'")
    located = own.select("talker", "sort_seq", "create_time", "server_id").withColumns({"media_kind": F.lit("image"), "filename": F.lit("a.dat")})
    out = s.export_text("alice", "now", located)
    assert "图片1（可在附件中查看）" in out and out.endswith("\n附件：\n\n[图片1] media/a.dat\n")
    m = "%032x" % 1
    rows = [("image", m, 1), ("voice", None, 2), ("video", "%032x" % 2, 3), ("file", "%032x" % 3, 4)]
    tasks = spark.createDataFrame([(i, i, 1704240000, "t", k, h, "a.pdf", f"{k}:{i}") for k, h, i in rows], "sort_seq long, server_id long, create_time long, talker string, media_kind string, md5 string, title string, task_key string")
    owner = __import__("hashlib").md5(b"t").hexdigest()
    files = spark.createDataFrame([(f"/m/{owner}/2024-01/Img/{m}.dat",), (f"/v/2024-01/{2:032x}.mp4",), ("/f/2024-01/a.pdf",)], "path string")
    links = spark.createDataFrame([], "md5 string, file_name string, dir1 string, dir2 string")
    blobs = spark.createDataFrame([("2", b"abc", "db")], "svr_id string, voice_data binary, db string")
    got = {r.server_id: (r.path, r.filename, r.voice_data and bytes(r.voice_data)) for r in media.located(tasks, files, links, blobs).collect()}
    assert got == {1: (f"/m/{owner}/2024-01/Img/{m}.dat", f"{m}.dat", None), 2: (None, "2.silk", b"abc"), 3: (f"/v/2024-01/{2:032x}.mp4", f"{2:032x}.mp4", None), 4: ("/f/2024-01/a.pdf", "a.pdf", None)}


def test_export(spark):
    s = store(spark)
    out = s.export_text("alice", "2024-01-01 00:00:00")
    assert out.startswith('"me"和"Alice"的聊天记录如下:\n\n导出时间：2024-01-01 00:00:00\n消息数：1\n时间范围：2023-11-14 ~ 2023-11-14\n')
    assert out.endswith("\n\n—————  2023-11-14  —————\n\nAlice（alice） 22:13\nhello from alice\n")
    assert [r.server_id for r in s.export("bob", everything=True).collect()] == [12]
    about = json.loads(export.to_json(s.history("alice"), s.messages.filter("talker = 'alice'"), "alice", "Alice", "now"))
    assert about["conversation"]["message_count"] == 1 and about["items"][0]["snippet"] == "hello from alice" and "md5" not in about["items"][0]["content"]
    d = s.export("g@chatroom", everything=True, show_hidden=True).withColumn("media_kind", F.when(F.col("server_id") != 15, "image")).withColumn("filename", F.concat(F.col("server_id").cast("string"), F.lit(".jpg")))
    text = export.txt(d, "G", "me", True, "now")
    assert "图片1（可在附件中查看）" in text and text.endswith("\n附件：\n\n[图片1] media/14.jpg\n\n[图片2] media/16.jpg\n")
    lines = {r.user_name: r.line for r in export.contact_lines(contacts(spark)).collect()}
    assert lines["bob"] == f"  {'Bobby / al2':<30} (bob)\n  └─ Memo: met in Oslo"


def test_media(spark):
    m = lambda n: f"{n:032x}"
    rows = [(1, 1, 1704240000, "t", "image", m(1), None), (2, 2, 1704240000, "t", "image", m(1), None), (3, 3, 1704240000, "t", "video", m(2), None), (4, 4, 1704240000, "t", "video", m(3), None), (5, 5, 1704240000, "t", "file", m(4), "a.pdf"), (6, 6, 1704240000, "t", "voice", None, None), (7, 7, 1704240000, "t", "video", m(9), None)]
    base = spark.createDataFrame(rows, "sort_seq long, server_id long, create_time long, talker string, k string, md5 string, title string")
    d = base.select("*", F.initcap("k").alias("content_kind"), F.struct("md5", "title").alias("content")).drop("md5", "title", "k")
    tasks = media.with_canonical(media.classify(d))
    assert {(r.server_id, r.is_dup) for r in tasks.filter("media_kind = 'image'").collect()} == {(1, False), (2, True)}
    owner = hashlib.md5(b"t").hexdigest()
    paths = [f"/r/attach/{owner}/2024-01/Img/{m(1)}{x}.dat" for x in ("", "_h", "_t")] + [f"/r/video/2024-02/{m(3)}.mp4", "/r/file/2024-01/a.pdf", "/r/attach/d1/d2/Video/v.mp4", "/r/file/2023-12/a.pdf"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    links = spark.createDataFrame([(m(2), "v.mp4", 1, 1, "d1", "d2")], "md5 string, file_name string, file_size long, modify_time long, dir1 string, dir2 string")
    assert {(r.path.rsplit("/", 1)[1], r.quality) for r in media.image_files(tasks, files).collect()} == {(f"{m(1)}_h.dat", "full")}
    videos = {r.server_id: (r.filename, r.tags) for r in media.video_files(tasks, links, files).collect()}
    assert videos == {3: ("v.mp4", []), 4: (f"{m(3)}.mp4", ["fallback_video"]), 7: (None, ["skipped_video"])}
    assert [(r.path, r.tags) for r in media.plain_files(tasks, links, files).collect()] == [("/r/file/2024-01/a.pdf", ["fallback_file"])]
    blobs = spark.createDataFrame([("6", bytearray(b""), "a.db"), ("6", bytearray(b"vv"), "b.db"), ("x", bytearray(b"no"), "a.db")], "svr_id string, voice_data binary, db string")
    assert [bytes(r.voice_data) for r in media.voices(tasks, blobs).collect()] == [b"vv"]
    tagged = spark.createDataFrame([(False, ["thumbnail_image"]), (True, ["thumbnail_image", "silk_voice"])], "is_dup boolean, tags array<string>")
    assert {tuple(r) for r in media.tag_stats(tagged).collect()} == {("thumbnail_image", 1), ("silk_voice", 1)}
    dirs = spark.createDataFrame([(1, "d1")], "id long, username string")
    table = spark.createDataFrame([("m", "x_h.jpg", 1, 1, 1, 5), ("m", "a.jpg", 1, 1, 1, 1)], "md5 string, file_name string, file_size long, modify_time long, dir1 long, dir2 long")
    assert [(r.file_name, r.dir1, r.dir2) for r in media.hardlinks(table, dirs, "m").collect()] == [("x_h.jpg", "d1", ""), ("a.jpg", "d1", "d1")]


def database(path, statements):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    for sql, rows in statements:
        db.executemany(sql, rows) if rows is not None else db.execute(sql)
    db.commit()
    db.close()


@pytest.fixture(scope="module")
def account(tmp_path_factory):
    root = tmp_path_factory.mktemp("account")
    zip_ = zstandard.ZstdCompressor().compress
    t1, t2 = ("Msg_" + hashlib.md5(x).hexdigest() for x in (b"alice", b"g@chatroom"))
    columns = "(sort_seq INT, server_id INT, local_type INT, real_sender_id INT, create_time INT, message_content BLOB, packed_info_data BLOB, status INT"
    link = (5 << 32) | 49
    database(
        root / "message/message_0.db",
        [
            ("CREATE TABLE Timestamp (timestamp INT)", None),
            ("INSERT INTO Timestamp VALUES (?)", [(1700000000,)]),
            ("CREATE TABLE Name2Id (user_name TEXT)", None),
            ("INSERT INTO Name2Id VALUES (?)", [("me",), ("alice",)]),
            (f"CREATE TABLE {t1} {columns}, WCDB_CT_message_content INT)", None),
            (f"INSERT INTO {t1} VALUES (?,?,?,?,?,?,?,?,?)", [(100, 1, 1, 1, 1, "plain", None, 0, 0), (200, 2, 1, 2, 2, zip_(b"packed"), None, 0, 4), (400, 4, 1, 1, 4, b"\x28\xb5\x2f\xfd\xff\xff\xff", None, 0, 4), (500, 5, link, 9, 5, "<title>T</title>", None, 0, 0)]),
            ("CREATE TABLE Msg_unknown (sort_seq INT, message_content TEXT)", None),
            ("INSERT INTO Msg_unknown VALUES (?,?)", [(1, "lost")]),
        ],
    )
    database(
        root / "message/message_1.db",
        [("CREATE TABLE Timestamp (timestamp INT)", None), ("INSERT INTO Timestamp VALUES (?)", [(1710000000,)]), (f"CREATE TABLE {t2} {columns})", None), (f"INSERT INTO {t2} VALUES (?,?,?,?,?,?,?,?)", [(500, 6, 1, 1, 6, "bob:\nin group", None, 0), (600, 7, 1, 1, 7, zip_(b"alice:\nzipped"), None, 0)])],
    )
    (root / "message/message_2.db").write_bytes(b"no database")
    database(root / "message/message_resource.db", [("CREATE TABLE x (y INT)", None)])
    label = b"\xf2\x01\x03" + b"5,6"
    database(root / "contact/contact.db", [
        ("CREATE TABLE contact (username TEXT, alias TEXT, remark TEXT, nick_name TEXT, extra_buffer BLOB)", None),
        ("INSERT INTO contact VALUES (?,?,?,?,?)", [("alice", None, "", "Alice", label), ("bob", "b", "Bobby", "", None)]),
        ("CREATE TABLE contact_label (label_id_ INT, label_name_ TEXT, sort_order_ INT)", None),
        ("INSERT INTO contact_label VALUES (?,?,?)", [(6, "Six", 1), (7, "Seven", 2)]),
        ("CREATE TABLE chat_room (username TEXT, owner TEXT, ext_buffer BLOB)", None),
        ("INSERT INTO chat_room VALUES (?,?,?)", [("g@chatroom", "bob", b"\n\x05\n\x03bob")]),
    ])
    database(root / "session/session.db", [("CREATE TABLE SessionTable (username TEXT, sort_timestamp INT, summary TEXT, last_msg_type INT)", None), ("INSERT INTO SessionTable VALUES (?,?,?,?)", [("alice", 5, zip_(b"sum"), link), ("g@chatroom", 7, "bob:\nhello", 1), ("silent", 1, "x", 1)])])
    return root


def test_open_store(spark, account, tmp_path):
    s = ChatStore.open(spark, str(account), "me")
    assert len(s.warnings) == 1 and "message_2.db" in s.warnings[0] and s.skipped == 1
    page = s.history("alice", order="asc")
    got = page.items.collect()
    assert [(r.sort_seq, r.sender, r.snippet) for r in got] == [(100, "me", "plain"), (200, "alice", "packed"), (500, "", "[链接] T")]
    assert page.to_dict()["stats"]["warnings"] == s.warnings
    assert [(r.sender, r.content.text) for r in s.history("g@chatroom", order="asc").items.collect()] == [("bob", "in group"), ("alice", "zipped")]
    assert [(r.username, r.summary, r.last_msg_type) for r in s.list_sessions().items.collect()] == [("g@chatroom", "hello", 1), ("alice", "sum", 49), ("silent", "x", 1)]
    people_ = {r.user_name: r for r in s.contacts.collect()}
    assert people_["alice"].labels == ["Six"] and people_["bob"].labels == [] and people_["alice"].alias == ""
    assert [[m.user_name for m in r.members] for r in s.list_chatrooms().items.collect()] == [["bob"]]
    assert s.search("zipped").total == 1
    starts = M.shard_ranges(Q.shard_starts(Q.shards(spark, str(account)))).orderBy("start_time").collect()
    assert [(r.shard_id, r.start_time, r.end_time) for r in starts] == [(2, 0, 1699999999), (0, 1700000000, 1709999999), (1, 1710000000, S.MAX_LONG)]
    write_messages(s.messages, f"{tmp_path}/silver")
    assert spark.read.parquet(f"{tmp_path}/silver").count() == 5
    with pytest.raises(FileNotFoundError):
        ChatStore.open(spark, str(account / "message"))


def test_index_files(spark, tmp_path):
    declared = "acontent, message_local_id, sort_seq, local_type, session_id, sender_id, create_time"
    row = lambda k, t: (t, k, k, 5 << 32 | 49, 1, 2 + k % 2, 100)
    own = [("CREATE TABLE name2id (username TEXT)", None), ("INSERT INTO name2id VALUES (?)", [("alice",), ("me",)])]
    for k in range(3):
        own += [(f"CREATE VIRTUAL TABLE message_fts_v4_{k} USING fts5({declared}, tokenize='ascii')", None), (f"INSERT INTO message_fts_v4_{k} VALUES (?,?,?,?,?,?,?)", [row(k, "running late"), row(9 - k, "late running")])]
    own += [(f"CREATE TABLE message_fts_v4_3 ({declared})", None), ("INSERT INTO message_fts_v4_3 VALUES (?,?,?,?,?,?,?)", [row(20, "run late"), (None, *row(21, "")[1:])])]
    database(tmp_path / "message/message_fts.db", own)
    (tmp_path / "message/bad_fts.db").write_bytes(b"no database")
    found = Q.files(spark, str(tmp_path), "*_fts.db")
    rows, names = Q.index_rows(found), Q.index_names(found)
    assert Q.good(rows).count() == 8 and [r.path.rsplit("/", 1)[1] for r in Q.warnings(rows).collect()] == ["bad_fts.db"]
    page = store(spark).search_files(Q.good(rows), Q.good(names), "Running-late", 2, 1)
    got = [(r.message_local_id, r.talker, r.sender, r.msg_type, r.sub_type, r.snippet) for r in page.items.collect()]
    assert page.total == 4
    assert got == [(2, "alice", "me", 49, 5, "running late"), (1, "alice", "unknown:3", 49, 5, "running late")]
    assert store(spark).search_files(Q.good(rows), Q.good(names), "").total == 0


def test_manifest(spark, account):
    files = manifest.listing(Q.files(spark, str(account), "*.db"))
    assert {r.category for r in files.collect()} == {"contact", "session", "message", "resource"}
    assert manifest.in_scope(files, "core").count() == 2 and manifest.in_scope(files, "shards", shards=[1]).count() == 3
    assert manifest.in_scope(files, "categories", ["message"]).count() == 3 and manifest.in_scope(files).count() == 6
    seen = spark.createDataFrame([], "path string, mtime timestamp")
    failed = files.filter("path like '%message_2.db'").select("path")
    after = manifest.after_ingest(files, seen, failed)
    assert after.count() == 5 and [r.path.rsplit("/", 1)[1] for r in manifest.changed(files, after).collect()] == ["message_2.db"]
    assert tuple(manifest.stats(files, after, failed).first()) == (0, 5, 1)
    with pytest.raises(OSError, match="no source"):
        manifest.after_ingest(files, after, failed)


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('[accounts.a]\nignore_contacts = [" x ", ""]\nignore_tags = ["T"]\n')
    assert Settings.load(str(f), "a") == Settings(["x"], ["T"]) and Settings.load(str(f), "b") == Settings() == Settings.load("/none", "a")


def test_session_pages_do_not_overlap(spark):
    d = spark.createDataFrame([(f"u{k:02}", 5 if k < 8 else k) for k in range(12)], "username string, sort_timestamp long")
    pages = [[r.username for r in people.sessions_page(d, 5, o).collect()] for o in (0, 5, 10)]
    assert sum(pages, []) == ["u11", "u10", "u09", "u08", *(f"u{k:02}" for k in range(8))]
    up = [r.username for r in people.sessions_page(d, 12, 0, True).collect()]
    assert up[:8] == [f"u{k:02}" for k in range(8)]


def test_names(spark):
    hits = spark.createDataFrame([(1, 2)], "session_id long, sender_id long")
    ids = spark.createDataFrame([(1, "one")], "id long, username string")
    assert tuple(people.name_hits(hits, ids).select("talker", "sender").first()) == ("one", "unknown:2")
    assert privacy.hidden_ids(contacts(spark), ["z"], []).collect()[0].id == "z"


def test_lines(spark):
    s = store(spark)
    both = s.export("g@chatroom", everything=True, order="asc").unionByName(s.export("alice", everything=True))
    assert {r.line for r in export.query_line(both).collect()} == {"11-14 22:13 [Bobby] [引用] re", "11-14 22:13 [我] open words", "11-14 22:13 << hello from alice"}
    assert [r.line for r in export.search_line(s.search("words").items).collect()] == ["11-14 22:13  [群「g@chatroom」] me: open words"]
    d = people.enrich_sessions(s.sessions, s.resolver, "me")
    lines = {r.username: r.line for r in export.watch_line(d, s.resolver, F.lit(3661)).collect()}
    assert lines["alice"] == "01:01:01 来自Alice（alice）：hi" and lines["bob"] == "01:01:01 发送给Bobby（bob）：yo"
    assert lines["g@chatroom"] == "01:01:01 来自群「g@chatroom」的Tag（tagged）：sum"


def test_routing(spark, tmp_path):
    ranges = M.shard_ranges(spark.createDataFrame([(0, 100), (1, 200), (2, 300)], "shard_id long, start_time long"))
    assert manifest.read_ranges(spark, f"{tmp_path}/r") is None
    manifest.write_ranges(ranges, f"{tmp_path}/r")
    kept = manifest.read_ranges(spark, f"{tmp_path}/r")
    manifest.write_ranges(ranges.filter("shard_id < 2"), f"{tmp_path}/r")
    assert kept.count() == 3 and manifest.read_ranges(spark, f"{tmp_path}/r").count() == 2
    assert manifest.routed(kept, 150, 250, None) == [0, 1] and manifest.routed(kept, 250, None, 260) == [1]
    assert manifest.routed(kept, None, None, 5) is None and manifest.routed(kept, 0, 999, None) is None and manifest.routed(None, 1, 2, 3) is None
