from pyspark.sql import functions as F

from talkweave.operators import resolve


def test_substrings_are_as_long_as_some_name(spark):
    d = spark.createDataFrame([(["abcab", "b", ""], [2, 4, 9]), (["é𝒳", None][:1], [1]), ([], [2])], "t array<string>, n array<int>")
    got = [len(r.x) for r in d.select(resolve.substrings(F.col("t"), F.col("n")).alias("x")).collect()]
    assert got == [3 + 2, 2, 0]  # ab, bc, ca; abca, bcab


def test_the_filter_keeps_every_key_and_few_others(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    k = F.pmod("key", F.lit(resolve.BITS))
    held = lambda d: d.filter(F.call_function("getbit", F.element_at(resolve.bit_filter(keys), (F.floor(k / 64) + 1).cast("int")), (k % 64).cast("int")) == 1).count()
    assert held(keys) == 2000
    assert held(spark.range(10000, 20000).select(F.xxhash64("id").alias("key"))) < 50
