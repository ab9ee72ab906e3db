import os
import sqlite3
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.sources import ingest
from talkweave.sources import sqlite_source as Q
from talkweave.store import ChatStore

T1 = "Msg_" + "6384e2b2184bcbf58eccf10ca7a6563c"  # of "alice"


def shard(path, rows, wal=False, table=T1):
    """A message file; wal: (committed rows, unfinished rows) of its log. The connection that keeps an unfinished log open."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    for end in ("", "-wal", "-shm"):
        if os.path.exists(path + end):
            os.unlink(path + end)
    db = sqlite3.connect(path, isolation_level=None)
    if wal:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute("PRAGMA wal_autocheckpoint=0")
    db.execute("BEGIN")
    db.execute("CREATE TABLE Name2Id (user_name TEXT)")
    db.execute("INSERT INTO Name2Id VALUES ('me'), ('alice')")
    db.execute(f'CREATE TABLE "{table}" (sort_seq INTEGER, server_id INTEGER, real_sender_id INT, create_time INTEGER, message_content TEXT, local_type INT DEFAULT 1)')
    put = lambda part: db.executemany(f'INSERT INTO "{table}" VALUES (?,?,1,?,?,1)', part)
    put(rows)
    db.execute("COMMIT")
    if not wal:
        db.close()
        return None
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    db.execute("BEGIN")
    put(wal[0])
    db.execute("COMMIT")
    db.execute("PRAGMA cache_size=1")
    db.execute("BEGIN")
    put(wal[1])
    return db


def rows(start, n, body="b"):
    return [(i, i, i, f"{body}{i}") for i in range(start, start + n)]


def test_filters_reach_the_files(spark, tmp_path, capsys):
    root = str(tmp_path)
    shard(f"{root}/message/message_0.db", [*rows(0, 100), (7, "odd", None, "x"), (5.5, 200, 90.5, "fraction")])
    shard(f"{root}/message/message_1.db", rows(0, 50), table="Msg_other")
    open(f"{root}/message/message_2.db", "wb").write(b"no database at all")
    whole = Q.raw_messages(spark, root)
    assert whole.filter("warning is null").count() == 152 and whole.filter("warning like 'damaged%'").count() == 1
    for where in ("create_time >= 90", "create_time = 90", "create_time < 3", "create_time > 97 AND sort_seq <= 98", "server_id IS NOT NULL AND create_time = 7", "sort_seq = 5", "create_time IS NULL", f"table_name = '{T1}' AND create_time <= 2", "table_name IN ('Msg_other', 'x') AND sort_seq > 48", "path LIKE '%_1.db' AND sort_seq = 1"):
        pushed = Q.raw_messages(spark, root, pushdown=True).filter(where)
        got, want = ([tuple(r) for r in d.orderBy("path", "table_name", "sort_seq", "server_id").collect()] for d in (x.filter("warning IS NULL") for x in (pushed, whole.filter(where))))
        assert got == want and len(got) > 0, where
    Q.conversation(spark, root, "alice", 10, 12).explain("formatted")
    plan = capsys.readouterr().out
    assert f"EqualTo(table_name,{T1})" in plan and "GreaterThanOrEqual(create_time,10)" in plan
    assert Q.conversation(spark, root, "alice", 10, 12).filter("warning is null").count() == 3
    # Without pushdown a relation may be used again with other filters.
    assert (whole.filter("create_time = 1").count(), whole.filter("create_time = 2").count(), whole.filter("warning is null").count()) == (2, 2, 152)


def test_reader_opens_only_what_is_asked_for():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("path", T.StringType()), T.StructField("table_name", T.StringType())])
    reader = Q.PushingReader({"files": '[["/a.db", 10], ["/b.db", 25]]', "splitbytes": "10"}, schema)
    left = list(reader.pushFilters([EqualTo(("path",), "/b.db"), GreaterThan(("n",), 4), StringStartsWith(("path",), "/")]))
    assert [type(f).__name__ for f in left] == ["StringStartsWith"]
    assert [(p.path, p.part, p.parts) for p in reader.partitions()] == [("/b.db", 0, 3), ("/b.db", 1, 3), ("/b.db", 2, 3)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE x (n INTEGER)"), db.execute("CREATE TABLE y (n TEXT)")
    assert reader._sql(db, "x") == ('SELECT "n" FROM "x" WHERE "n" > ?', [3]) and reader._sql(db, "y") == ('SELECT "n" FROM "y"', [])


def test_parts_of_a_file_hold_each_table_once(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    db = sqlite3.connect(path)
    for k in range(20):
        db.execute(f"CREATE TABLE t{k} (n INTEGER, extra TEXT)")
        db.execute(f"INSERT INTO t{k} VALUES ({k}, 'x')")
    db.commit()
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("lacking", T.StringType())])
    d = Q.tables(spark, str(tmp_path), schema, "t*", splitbytes=10_000)
    assert sorted(r.n for r in d.collect()) == list(range(20)) and d.rdd.getNumPartitions() > 3
    assert Q.tables(spark, str(tmp_path), schema, "none*").count() == 0


def test_logs_are_recovered_up_to_their_last_commit(spark, tmp_path):
    path = f"{tmp_path}/message/message_0.db"
    db = shard(path, rows(0, 10), (rows(10, 5), rows(1000, 3000)))
    before = {e: os.path.getsize(path + e) for e in ("", "-wal")}
    assert before["-wal"] > 20_000  # the unfinished tail is in the log
    got = Q.raw_messages(spark, str(tmp_path)).filter("warning is null").select("sort_seq").collect()
    assert sorted(r.sort_seq for r in got) == list(range(15))
    assert {e: os.path.getsize(path + e) for e in ("", "-wal")} == before
    db.close()
    with open(path + "-wal", "wb") as f:  # a log of another time is no log of this file
        f.write(os.urandom(5000))
    assert Q.raw_messages(spark, str(tmp_path)).filter("warning is null").count() >= 10


def test_ingest_reads_what_changed_and_remembers_what_is_damaged(spark, tmp_path, monkeypatch):
    root, at = f"{tmp_path}/acc", f"{tmp_path}/kept"
    paths = [f"{root}/message/message_{k}.db" for k in range(3)]
    for k, p in enumerate(paths):
        shard(p, rows(100 * k, 10))
    seqs = lambda: sorted(r.sort_seq for r in ingest.messages(spark, at).collect())
    assert ingest.step(spark, root, at) == {"ingested": 3, "skipped": 0, "errors": 0}
    assert ingest.step(spark, root, at) == {"ingested": 0, "skipped": 3, "errors": 0} and len(seqs()) == 30
    shard(paths[0], rows(0, 5))  # changed
    open(paths[1], "wb").write(b"broken")
    os.utime(paths[0], (1, 1)), os.utime(paths[1], (2, 2))
    assert ingest.step(spark, root, at) == {"ingested": 1, "skipped": 1, "errors": 1}
    assert seqs() == [*range(5), *range(100, 110), *range(200, 210)]  # the damaged file's earlier rows stay
    held = {r.path.rsplit("/", 1)[-1]: (r.status, r.held) for r in ingest.manifest(spark, at).collect()}
    assert held == {"message_0.db": ("ok", 2), "message_1.db": ("damaged", 1), "message_2.db": ("ok", 1)}
    assert ingest.step(spark, root, at) == {"ingested": 0, "skipped": 3, "errors": 0}  # not tried again
    db = shard(paths[2], rows(200, 2), (rows(300, 4), rows(900, 1)))  # its log makes it new
    os.utime(paths[2], (3, 3))
    assert ingest.step(spark, root, at)["ingested"] == 1 and seqs()[-4:] == [300, 301, 302, 303]
    db.execute("COMMIT")
    os.utime(paths[2] + "-wal", (9, 9))  # the log alone has changed
    assert ingest.step(spark, root, at)["ingested"] == 1 and seqs()[-1] == 900
    db.close()
    shard(paths[1], rows(100, 1))
    os.unlink(paths[0])
    assert ingest.step(spark, root, at)["ingested"] >= 1
    assert 0 not in seqs() and seqs().count(100) == 1  # repaired, and gone
    names = {(r.id, r.user_name) for r in ingest.sender_names(spark, at).collect()}
    assert names == {(1, "me"), (2, "alice")}


def test_nothing_readable_is_an_error_and_lost_steps_are_done_again(spark, tmp_path):
    root, at = f"{tmp_path}/acc", f"{tmp_path}/kept"
    os.makedirs(f"{root}/message")
    open(f"{root}/message/message_0.db", "wb").write(b"broken")
    with pytest.raises(OSError, match="no source file"):
        ingest.step(spark, root, at)
    shard(f"{root}/message/message_0.db", rows(0, 3))
    # A step that was lost before its manifest left rows of version 1.
    Q.raw_messages(spark, root).write.parquet(f"{at}/messages/version=1", mode="overwrite")
    assert ingest.step(spark, root, at)["ingested"] == 1 and ingest.messages(spark, at).count() == 3


def test_a_stream_takes_steps_and_a_store_opens_them(spark, tmp_path):
    root, at = f"{tmp_path}/acc", f"{tmp_path}/kept"
    shard(f"{root}/message/message_0.db", rows(0, 4))
    for _ in range(2):
        ingest.follow(spark, root, at).awaitTermination()
    q = ingest.follow(spark, root, at, 0.2)
    try:
        shard(f"{root}/message/message_1.db", rows(10, 4))
        for _ in range(100):
            q.awaitTermination(0.3)
            if ingest.manifest(spark, at).agg(F.max("version")).first()[0] == 2:
                break
    finally:
        while q.status["isTriggerActive"]:
            time.sleep(0.01)
        q.stop()
    assert ingest.messages(spark, at).count() == 8
    for name, table in (("contact", "CREATE TABLE contact (username TEXT, nick_name TEXT)"), ("session", "CREATE TABLE SessionTable (username TEXT, sort_timestamp INT)")):
        os.makedirs(f"{root}/{name}")
        db = sqlite3.connect(f"{root}/{name}/{name}.db")
        db.execute(table)
        db.execute(f"INSERT INTO {table.split()[2]} VALUES ('alice', 1)")
        db.commit()
    s = ChatStore.open(spark, root, "me", ingested=at)
    got = s.history("alice", order="asc").items.collect()
    assert [(r.sort_seq, r.sender, r.snippet) for r in got] == [(i, "me", f"b{i}") for i in (0, 1, 2, 3, 10, 11, 12, 13)] and s.warnings == []


def test_resources_by_local_id(spark, tmp_path):
    from talkweave.operators import media

    digest = b"0123456789abcdef" * 2
    mark = b"\x12\x22\x0a\x20"
    os.makedirs(f"{tmp_path}/message")
    for name, rows in (("message_resource.db", [(1, mark + digest), (2, b"none"), (3, None), (5, mark + digest[::-1])]), ("message_resource_1.db", [(5, mark + digest), (6, digest)])):
        db = sqlite3.connect(f"{tmp_path}/message/{name}")
        db.execute("CREATE TABLE MessageResourceInfo (local_id INTEGER, packed_info BLOB)")
        db.executemany("INSERT INTO MessageResourceInfo VALUES (?, ?)", rows)
        db.commit()
        db.close()
    with open(f"{tmp_path}/message/message_resource_2.db", "wb") as f:
        f.write(b"no database")
    one = Q.resources(spark, str(tmp_path), 5)
    assert sorted(bytes(r.packed_info) for r in one.filter("warning is null").collect()) == sorted([mark + digest[::-1], mark + digest])
    assert Q.resources(spark, str(tmp_path), 9).filter("warning is null").count() == 0
    every = Q.resources(spark, str(tmp_path))
    assert every.filter("warning is not null").count() == 1
    d = spark.createDataFrame([(k, f"m{k}") for k in (1, 1, 2, 3, 4, 5, 6)] + [(None, "x")], "local_id long, m string")
    got = sorted((r.m, r.resource_md5) for r in media.with_resource(d, every).collect())
    text = digest.decode()
    assert got == [("m1", text), ("m1", text), ("m2", None), ("m3", None), ("m4", None), ("m5", text[::-1]), ("m6", text), ("x", None)]
