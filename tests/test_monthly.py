import re

import pytest
from pyspark.sql import functions as F

from talkweave.operators import messages as M
from talkweave.operators import timeline as T
from talkweave.operators.privacy import drop_hidden_senders, visible
from talkweave.sources import monthly
from talkweave.sources.adapters import text_content

MONTH = 30 * 86400
KIND = "talker string, sender string, msg_type long, sort_seq long, create_time long, server_id long, content_kind string, body string"


def made(spark, out):
    return spark.createDataFrame(out, KIND).select("*", text_content(F.col("body")).alias("content")).drop("body")


def rows(spark, months, follows=True):
    """Three conversations over months; without follows the order is not that of time."""
    out = []
    for k in range(months * 40):
        t = k * MONTH // 40
        seq = t * 1000 if follows else (k * 7919 % (months * 40)) // 2 * 1000
        out.append((("a", "b", "g@chatroom", "h")[k % 4], ("x", "y", "z")[k % 3], 1 + k % 2, seq, t, k, "Text", f"word{k % 97}"))
    return made(spark, out)


def months_read(d):
    found = re.findall(r"PartitionFilters: \[([^\]]*)\]", d._jdf.queryExecution().executedPlan().toString())
    return set(re.findall(r"\d{4}-\d\d", " ".join(found)))


QUERIES = [
    {"talker": "a", "limit": 7}, {"talker": "a", "limit": 7, "offset": 25, "ascending": True}, {"talker": "g@chatroom", "limit": 9, "msg_type": 1}, {"limit": 30}, {"talker": "b", "limit": 500},
    {"talker": "b", "limit": 5, "since": 3 * MONTH + 5000, "until": 7 * MONTH}, {"talker": "a", "limit": 6, "after_sort_seq": 2 * MONTH * 1000}, {"talker": "a", "limit": 3, "keyword": "WORD12"}, {"talker": "nobody", "limit": 3},
    {"talker": "a", "around_sort_seq": 40 * MONTH // 40 * 1000, "context": 3}, {"talker": "b", "limit": 4, "keyword": "absent"}, {"talker": "h", "limit": 4},
]


@pytest.mark.parametrize("follows", [True, False])
def test_pages_equal_those_of_all_rows(spark, tmp_path, follows):
    d = rows(spark, 12, follows)
    monthly.write(d, str(tmp_path))
    hidden = spark.createDataFrame([("h",), ("y",)], "id string")
    for how in QUERIES:
        q = M.MessageQuery(**how)
        for h in (None, hidden):
            seen = d if h is None else drop_hidden_senders(visible(d, h), h)
            got = [tuple(r[c] for c in M.KEY) for r in monthly.page(spark, str(tmp_path), q, h).collect()]
            assert got == [tuple(r[c] for c in M.KEY) for r in M.page(seen, q).collect()], how


def test_a_page_reads_as_many_months_of_a_long_store_as_of_a_short_one(spark, tmp_path):
    for months in (6, 48):
        at = f"{tmp_path}/{months}"
        monthly.write(rows(spark, months), at)
        assert len(months_read(monthly.page(spark, at, M.MessageQuery(talker="a", limit=12)))) == 2
        assert len(months_read(monthly.page(spark, at, M.MessageQuery(talker="a", limit=12, ascending=True)))) == 2
        assert monthly.reach(spark.read.parquet(f"{at}/counts"), M.MessageQuery(), 20)[0] != []


def test_timelines_equal_those_of_all_rows_and_read_few_months(spark, tmp_path):
    d, at = rows(spark, 12), str(tmp_path)
    monthly.write(d, at)
    sessions = spark.createDataFrame([("a",), ("g@chatroom",), ("h",), ("h",)], "username string")
    for hidden in (None, spark.createDataFrame([("h",), ("y",)], "id string")):
        for since, until, kind in ((0, 12 * MONTH, None), (2 * MONTH + 9999, 7 * MONTH + 5, 1), (99 * MONTH, 100 * MONTH, None)):
            want = sorted(tuple(r) for r in T.timeline(d, sessions, since, until, kind, hidden).select(*T.KEY, "talker").collect())
            for up, need in ((False, 30), (True, 1), (True, 10_000)):
                got, total = monthly.timeline(spark, at, sessions, since, until, kind, hidden, need, up)
                assert total == len(want)
                assert sorted((tuple(r) for r in got.select(*T.KEY, "talker").collect()), reverse=not up)[:need] == (want if up else want[::-1])[:need]
    got, _ = monthly.timeline(spark, at, sessions, 0, 12 * MONTH, need=40)
    assert len(months_read(got)) == 2
    with pytest.raises(ValueError):
        monthly.timeline(spark, at, sessions, 5, 4)


def test_rows_without_a_time_and_an_empty_store(spark, tmp_path):
    d = made(spark, [("a", "x", 1, 5, None, 1, "Text", "t"), ("a", "x", 1, 6, 10, 2, "Text", "t")])
    monthly.write(d, f"{tmp_path}/one")
    assert [r.server_id for r in monthly.page(spark, f"{tmp_path}/one", M.MessageQuery(talker="a", limit=5)).collect()] == [2, 1]
    monthly.write(d.limit(0), f"{tmp_path}/none")
    assert monthly.page(spark, f"{tmp_path}/none", M.MessageQuery(talker="a")).count() == 0


def test_history_of_a_store_by_months(spark, tmp_path):
    from test_operators import store

    plain, kept = store(spark), store(spark).by_months(str(tmp_path))
    for how in ({"limit": 2}, {"order": "asc", "limit": 3, "offset": 1}, {"keyword": "e"}):
        for who in ("alice", "g@chatroom"):
            assert kept.history(who, **how).to_dict() == plain.history(who, **how).to_dict()
    for how in ({"limit": 3}, {"order": "asc", "limit": 2, "offset": 1, "show_hidden": True}, {"type": "text"}):
        assert kept.timeline(0, 2_000_000_000, **how).to_dict() == plain.timeline(0, 2_000_000_000, **how).to_dict()
