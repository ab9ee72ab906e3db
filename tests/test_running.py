import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave.operators import export
from talkweave.operators import messages as M
from talkweave.operators.running import ranged, running

KIND = "talker string, sort_seq long, create_time long, server_id long, media_kind string"


def hot(spark, n=3000):
    """One talker with nearly all rows, ties of two keys, a null talker, null kinds and repeated rows."""
    rows = [("hot", k // 3, k // 7 * 40000, k, ("image", None, "file", "voice", "image")[k % 5]) for k in range(n)]
    return spark.createDataFrame([*rows, ("one", 5, 5, 5, "file"), (None, 1, 1, 1, "file"), (None, 2, 2, 2, None), ("two", 1, 1, 1, None), ("two", 1, 1, 1, None)], KIND).repartition(4)


def same(a, b):
    return sorted(map(repr, map(tuple, a.select(*b.columns).collect()))) == sorted(map(repr, map(tuple, b.collect())))


def plain(d):
    """The same values by windows."""
    w = Window.partitionBy("talker").orderBy(*M.ordered(True))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({"rank": F.row_number().over(w), "images": F.sum((F.coalesce("media_kind", F.lit("")) == "image").cast("long")).over(up), "before": F.lag("media_kind").over(w)})


@pytest.mark.parametrize("ranges", [1, 3, 16, None])
def test_running_equals_windows(spark, ranges):
    d = hot(spark)
    got = running(d, ["talker"], M.ordered(True), "rank", {"images": F.col("media_kind") == "image"}, {"before": "media_kind"}, ranges)
    assert same(got, plain(d))


def test_a_busy_group_is_many_ranges(spark):
    d = ranged(hot(spark), ["talker"], M.ordered(True), 16).filter("talker = 'hot'")
    each = d.groupBy("__range").agg(F.count("*").alias("n"), F.min("server_id").alias("low"), F.max("server_id").alias("high")).orderBy("__range").collect()
    assert len(each) >= 14 and max(r.n for r in each) < 600
    assert all(a.high < b.low for a, b in zip(each, each[1:], strict=False))


def test_no_window_of_a_whole_group(spark):
    d = running(hot(spark), ["talker"], M.ordered(True), "rank", {"images": F.col("media_kind") == "image"}, {"before": "media_kind"}, 8)
    windows = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("__range" in x for x in windows)


def test_empty(spark):
    d = running(hot(spark).limit(0), ["talker"], M.ordered(True), "rank", {"images": F.lit(True)}, {"before": "media_kind"})
    assert d.columns[-3:] == ["images", "before", "rank"] and d.count() == 0


@pytest.mark.parametrize("context", [0, 1, 4])
def test_around_many_equals_single_pivots(spark, context):
    d = hot(spark, 300).filter("talker is not null").select("talker", *M.KEY)
    asked = [("hot", 0), ("hot", 50), ("hot", 51), ("hot", 99), ("hot", 1000), ("one", 4), ("one", 5), ("two", 1), ("nobody", 3)]
    got = M.around_many(d, spark.createDataFrame([*asked, ("one", 5)], "talker string, pivot_seq long"), context).collect()
    want = []
    for t, s in asked:
        rows = M.page(d, M.MessageQuery(talker=t, around_sort_seq=s, context=context)).collect()
        want += [(t, s, r.sort_seq, r.create_time, r.server_id) for r in rows]
    assert sorted((r.talker, r.pivot_seq, r.sort_seq, r.create_time, r.server_id) for r in got) == sorted(want)


def test_export_of_a_busy_conversation(spark):
    d = hot(spark)
    w = Window.partitionBy("talker").orderBy(*M.ordered(True))
    day = F.to_date(F.timestamp_seconds("create_time"))
    want = d.withColumn("is_break", ~F.coalesce(F.lag(day).over(w) == day, F.lit(False)))
    assert same(export.date_breaks(d), want)
    own = Window.partitionBy("talker", "media_kind").orderBy(*M.ordered(True)).rowsBetween(Window.unboundedPreceding, 0)
    want = d.withColumn("number", F.when(F.col("media_kind").isNotNull(), F.count("*").over(own)))
    assert same(export.counters(d), want)
