import json

from test_operators import store, text_row
from test_operators import messages as message_rows

from talkweave.plans.streams import replay
from talkweave.streaming import changes as C


def test_session_diff(spark):
    rows = [(0, "a", 10), (0, "b", 5), (1, "a", 10), (1, "b", 7), (2, "a", 8), (3, "a", 10), (3, "c", 1)]
    d = spark.createDataFrame(rows, "snapshot long, username string, sort_timestamp long").repartition(3)
    want = {(0, "a", 10), (0, "b", 5), (1, "b", 7), (3, "a", 10), (3, "c", 1)}
    assert {tuple(r) for r in C.replay_sessions(d).collect()} == want
    assert {tuple(r) for r in replay(spark, d, C.session_events).collect()} == want


def test_baseline_is_silent(spark):
    d = spark.createDataFrame([(1, "a", 10), (1, "b", 7)], "snapshot long, username string, sort_timestamp long")
    known = spark.createDataFrame([("a", 10)], "username string, sort_timestamp long")
    assert [tuple(r) for r in replay(spark, d, lambda s: C.session_events(s, known)).collect()] == [(1, "b", 7)]


def test_cursors(spark):
    rows = [("a", k, k, k) for k in (5, 6, 7)] + [("new", 3, 3, 3), ("new", 9, 9, 9)]
    d = spark.createDataFrame(rows, "talker string, sort_seq long, create_time long, server_id long")
    cursors = spark.createDataFrame([("a", 5)], "talker string, max_seq long")
    got = replay(spark, d, lambda s: C.tagged(C.new_messages(s, 8, cursors), "message")).collect()
    assert sorted(r.payload for r in got) == ['{"talker":"a","sort_seq":6,"create_time":6,"server_id":6}', '{"talker":"a","sort_seq":7,"create_time":7,"server_id":7}', '{"talker":"new","sort_seq":9,"create_time":9,"server_id":9}']


def test_cursors_over_batches(spark):
    d = spark.createDataFrame([("a", k, k, k) for k in (5, 6, 4, 7, 6, 8)] + [("b", 1, 1, 1)], "talker string, sort_seq long, create_time long, server_id long")
    batches = [d.filter("sort_seq in (5, 6)"), d.filter("sort_seq = 4"), d.filter("sort_seq in (1, 6, 7, 8)")]
    got = replay(spark, batches, C.new_messages).collect()
    assert sorted((r.talker, r.sort_seq) for r in got) == [("a", 5), ("a", 6), ("a", 6), ("a", 7), ("a", 8), ("b", 1)]


def test_store_events_and_watch(spark, tmp_path):
    s, t = store(spark), 1700000000
    assert s.health() == {"messages": 7, "sessions": 4, "contacts": 4}
    listing = s.sessions.selectExpr("1L AS snapshot", "*").filter("username != 'bob'")
    listing.write.parquet(f"{tmp_path}/sessions")
    rows = [text_row(1, 11, t + 1, "alice", "alice"), text_row(9, 19, t + 9, "alice", "alice"), text_row(9, 29, t + 9, "tagged", "tagged"), text_row(5, 39, t, "late"), text_row(8, 49, t, "late")]
    message_rows(spark, rows).select("talker", "sort_seq", "create_time", "server_id").write.parquet(f"{tmp_path}/messages")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.STORE)
    try:
        read = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")
        known = s.sessions.filter("username = 'g@chatroom'").select("username", "sort_timestamp")
        C.write_json(s.events(read("sessions"), read("messages"), known), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        C.write_json(s.watch(read("sessions")), f"{tmp_path}/watch", f"{tmp_path}/state2").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [(r.type, json.loads(r.payload)) for r in spark.read.json(f"{tmp_path}/out").collect()]
    assert sorted(p["username"] for k, p in got if k == "session") == ["alice"]  # the group did not move, one is hidden
    assert sorted(p["server_id"] for k, p in got if k == "message") == [19, 49]
    seen = {r.username: r for r in spark.read.json(f"{tmp_path}/watch").collect()}
    assert set(seen) == {"alice", "g@chatroom"} and seen["alice"].display_name == "Alice（alice）" and seen["g@chatroom"].last_msg_sender is None
