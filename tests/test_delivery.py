import pytest
from pyspark.sql import functions as F

from talkweave.streaming import delivery as D


def events(spark, rows):
    return spark.createDataFrame([(*r, f'{{"id":{r[3]}}}') for r in rows], D.EVENT).repartition(3)


FIRST = [("message", "b", 5, 1), ("session", "b", 1, None), ("message", "a", 7, 2), ("message", "b", 4, 3), ("session", "a", 1, None)]
SECOND = [("message", "a", 8, 4), ("session", "a", 2, None)]


def told(d):
    return [(r.position, r.batch, r.type, r.talker, r.id) for r in d.orderBy("position").collect()]


WHOLE = [(1, 0, "session", "a", None), (2, 0, "message", "a", 2), (3, 0, "session", "b", None), (4, 0, "message", "b", 3), (5, 0, "message", "b", 1), (6, 1, "session", "a", None), (7, 1, "message", "a", 4)]


def test_a_batch_is_delivered_once(spark, tmp_path):
    at = str(tmp_path)
    assert told(D.read(spark, at)) == [] and D.epoch(spark, at) == 0 and D.last(spark, at) == (-1, 0)
    assert D.commit(events(spark, FIRST), 0, at) and D.commit(events(spark, SECOND), 1, at)
    assert not D.commit(events(spark, SECOND), 1, at) and not D.commit(events(spark, FIRST), 0, at)
    assert told(D.read(spark, at)) == WHOLE and D.epoch(spark, at) == 2 and D.last(spark, at) == (1, 7)
    assert D.commit(events(spark, []), 2, at) and told(D.read(spark, at)) == WHOLE and D.last(spark, at) == (2, 7)


def test_events_without_a_ledger_row_are_not_seen(spark, tmp_path):
    at = str(tmp_path)
    D.commit(events(spark, FIRST), 0, at)
    events(spark, SECOND).withColumn("position", F.lit(6).cast("long")).write.parquet(f"{at}/events/batch=1")  # lost before its ledger row
    assert told(D.read(spark, at)) == WHOLE[:5] and D.epoch(spark, at) == 1
    D.commit(events(spark, SECOND), 1, at)
    assert told(D.read(spark, at)) == WHOLE


@pytest.mark.parametrize(("after", "buffer", "want"), [(0, None, WHOLE), (5, None, WHOLE[5:]), (6, 512, WHOLE[6:]), (7, 512, []), (9, None, []), (0, 3, WHOLE[4:]), (6, 3, WHOLE[6:]), (0, 0, [])])
def test_readers_that_lag_get_the_buffer(spark, tmp_path, after, buffer, want):
    at = str(tmp_path)
    D.commit(events(spark, FIRST), 0, at)
    D.commit(events(spark, SECOND), 1, at)
    d = D.read(spark, at, after, buffer)
    assert told(d) == want
    if want and want[0][0] > 5:  # only the last batch's files are read
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert ">= 1)" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_a_lost_batch_of_a_stream_is_run_again(spark, tmp_path, monkeypatch):
    at, tried, real = f"{tmp_path}/to", [], D.commit
    stream = lambda: spark.readStream.schema(D.EVENT).parquet(f"{tmp_path}/in")

    def failing(d, batch, where, lose=None):
        tried.append((batch, real(d, batch, where)))
        if lose == batch:
            raise RuntimeError("lost after its ledger row, before the checkpoint")

    events(spark, FIRST).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(D, "commit", lambda d, b, w: failing(d, b, w, 0))
    with pytest.raises(Exception, match="lost after"):
        D.deliver(stream(), at).awaitTermination()
    monkeypatch.setattr(D, "commit", failing)
    D.deliver(stream(), at).awaitTermination()
    events(spark, SECOND).write.mode("append").parquet(f"{tmp_path}/in")
    D.deliver(stream(), at).awaitTermination()
    assert tried == [(0, True), (0, False), (1, True)]
    assert told(D.read(spark, at)) == WHOLE


def test_the_query_runs_its_second_batch_three_times(spark, monkeypatch):
    from talkweave.plans.streams import delivered_events

    tried, real = [], D.commit
    monkeypatch.setattr(D, "commit", lambda d, b, w: tried.append((b, real(d, b, w))))
    delivered_events(spark, "/root/testdata/sf0.001")
    assert tried == [(0, True), (1, True), (1, True), (1, False)]
