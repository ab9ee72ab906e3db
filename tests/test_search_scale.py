import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_operators import messages, text_row

from talkweave.functions.stemmer import stem, stem_sources
from talkweave.functions.tokens import Options, forms, pieces, tokenize, tokens, words
from talkweave.operators import search

TEXTS = ["Running runs RUN", "don't stop", "", None, "  ", "äÖ Über İK straße", "跑 Running。好", "😀x𝒳y", "a1b22 c!", "the dying news\tof\nskies", "’q　r"]


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_cut_as_before(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    for o in (Options(), Options(stemming=False), Options(numbers=True), Options(symbols=True, stemming=False)):
        assert {r.k: r.x for r in d.select("k", tokens(F.col("t"), o).alias("x")).collect()} == {k: tokenize(t, o) for k, t in enumerate(TEXTS)}
    assert d.select(words(F.col("t")).alias("x")).filter("x is null").count() == 0


def test_an_index_with_stems_joins_no_words_and_a_search_reads_it_once(spark):
    docs, postings = search.build_index(messages(spark, [text_row(k, k, k, body=f"running the {'far ' * k}ways") for k in range(1, 4)]))
    assert "Join" not in plan(postings) and "Aggregate" not in plan(postings)
    hits = search.indexed_search(docs, postings, "run the-far ways")
    assert plan(hits).count("Generate explode") == 1 and {r.server_id for r in hits.collect()} == {1, 2, 3}
    assert search.indexed_search(docs, postings, "the-far-far run-the-far").count() == 2
    long = "-".join(["run", "the", *["far"] * 3, "way"])
    assert [r.server_id for r in search.indexed_search(docs, postings, long).collect()] == [3]


def test_phrases_of_over_sixty_words(spark):
    body = " ".join(np.array(list("abcdefg"))[np.arange(130) ** 2 % 7])
    docs, postings = search.build_index(messages(spark, [text_row(1, 1, 1, body=body), text_row(2, 2, 2, body=body[:-1] + "z")]), Options(stemming=False))
    assert [r.server_id for r in search.indexed_search(docs, postings, body.replace(" ", "-"), Options(stemming=False)).collect()] == [1]


def test_python_sees_the_distinct_words_of_a_batch(spark):
    d = spark.createDataFrame([(k, "running " * 500 + f"x{'y' * (k % 3)}") for k in range(200)], "k int, t string")
    got = d.select("k", tokens(F.col("t")).alias("x"))
    assert "stemmed" in got._jdf.queryExecution().executedPlan().toString() or "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter(F.size("x") != 501).count() == 0
    assert "regexp_extract_all" in plan(got) and "split" in plan(got)  # texts are cut before Python


def test_postings_are_not_dealt_and_are_clustered_by_token(spark, tmp_path):
    docs, _ = search.build_index(messages(spark, [text_row(k, k, 1700000000 + k % 2 * 2629800, body=f"b a c{'d' * (k % 5)}") for k in range(40)]), Options(stemming=False))
    name = search.write_segment(docs.withColumn("month", search._month()), str(tmp_path), Options(stemming=False), part=64)
    parts = [pq.ParquetFile(p).read() for p in (tmp_path / "segments" / name / "postings").glob("*.parquet")]
    parts = [p for p in parts if p.num_rows]
    assert len(parts) > 3 and sum(p.num_rows for p in parts) == 120
    owners = [set(p["doc"].to_pylist()) for p in parts]
    assert sum(map(len, owners)) == 40  # a document's postings are in one part
    assert all(p["token"].to_pylist() == sorted(p["token"].to_pylist()) for p in parts)


def test_the_words_of_a_stem_are_all_found():
    seen = "run runs running the dying die skies sky news happy happiness hopped hoping rational relational conditionally vietnamization sensibilities playing played agreed agreedly caresses ties cries falling fall generously inning analogy probate rate oneself generalizations eres eredly".split()
    for w in seen:
        assert w in stem_sources(stem(w))
    assert {"run", "runs", "running"} <= stem_sources("run") and all(stem(w) == "run" for w in stem_sources("run"))
    assert "runningness" in stem_sources("running") and {"run", "runs", "running", "runningness"} <= {*forms(["run", "running"])}
    assert forms(["跑"]) == ["跑"] and forms(["running"], Options(stemming=False)) == ["running"]


def test_a_search_of_rows_with_stems_runs_no_python_and_finds_the_same(spark):
    d = spark.createDataFrame(list(enumerate([*TEXTS, "Ärzte Ä", "run-time", "the skis run", "runner's", "it's a\\b ok", "general", "x " * 3000 + "running the end"])), "k int, t string")
    for o in (Options(), Options(stemming=False), Options(numbers=True, symbols=True)):
        by_tokens = d.withColumn("tokens", tokens(F.col("t"), o))
        for q in ("running", "run-runs", "Running the", "ski-run", "Ä", "don't", "a\\b", "generalization") if o == Options() else ("跑-run", "don't a\\b"):
            by_text = search.phrase_search(d, q, options=o, text=F.col("t"))
            assert by_text.columns == d.columns and "Python" not in by_text._jdf.queryExecution().executedPlan().toString()
            assert sorted(r.k for r in by_text.collect()) == sorted(r.k for r in search.phrase_search(by_tokens, q, options=o).collect()), (o, q)
    assert search.phrase_search(d, "running", text=F.col("t")).count() > 2


def test_python_gets_bounded_pieces_of_texts_for_an_index(spark):
    body = "running " * 1000 + "the end"
    docs, postings = search.build_index(messages(spark, [text_row(1, 1, 1, body=body), text_row(2, 2, 2, body="end"), text_row(3, 3, 3, body=" ")]))
    steps = plan(postings).split("\n")
    python, cut = next(k for k, x in enumerate(steps) if "ArrowEvalPython" in x), next(k for k, x in enumerate(steps) if "slice" in x)
    assert python < cut  # texts are cut to pieces below Python
    got = sorted((r.pos, r.token) for r in postings.join(docs.filter("server_id = 1"), "doc").collect())
    assert got == sorted((k, t) for k, own in enumerate(tokenize(body)) for t in own)
    sizes = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (0, 1, 64, 65, 200)], "n int, t string").select("n", F.transform(pieces(words(F.col("t"))), F.size).alias("s"))
    assert {r.n: r.s for r in sizes.collect()} == {0: [], 1: [1], 64: [64], 65: [64, 1], 200: [64, 64, 64, 8]}
