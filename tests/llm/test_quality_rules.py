import re
from collections import Counter

import duckdb

from talkweave.llm.q_quality_rules import SQL
from talkweave.llm.quality_rules import assess, clean

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words"]


def fixture():
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(15))
    rows = [(i, f"{own(i)}\n  Share  This page NOW\n{own(i + 1000)}", "a") for i in range(30)]  # boilerplate
    rows += [(100 + i, "copied first line here\n" + own(77) + "\n" + own(78), "a") for i in range(40)]  # copies
    rows += [(200, None, "a"), (201, "", "a"), (202, "one two", None), (203, "a b c d e " * 6, "b"), (204, "x # y\n\n\x0b\nx # y\n$%&|<>", "b")]
    rows += [(None, own(5), "c"), (205, own(6), None), (205, own(6), None), (206, "é" * 30 + " " + own(9), "c"), (207, "x y z " * 4000, "c")]
    rows += [(300 + i, "share this page now\nshort tail %d" % i, "a") for i in range(5)]  # depleted
    rows += [(400, "p q r s t u p q r s t v " + own(11), "d"), (401, "a a a a a a a", "d")]
    return rows


def brute(rows):
    out = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        spots = {k + j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(spots), len(w) < 10 or 100 * len(spots) > 20 * len(w)))
    return out


def test_base_and_verdict(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, row int").repartition(3)
    got = assess(docs).select(COLUMNS).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r)[:7] for r in got], key=key) == sorted(brute(rows), key=key)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(30)) and all(kept[100 + i] for i in range(40))
    assert not any(kept[300 + i] for i in range(5))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({SQL})").fetchall(), key=key) == sorted(map(tuple, got), key=key)


def test_clean_removes_lines_and_documents(spark):
    docs = spark.createDataFrame([(*r, 7) for r in fixture()], "doc_id long, text string, source string, row int")
    out = clean(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[3].count("\n") == 1 and "Share" not in text[3]
    assert text[110].startswith("copied first") and 300 not in text and 200 not in text
    assert out.filter("doc_id = 205").count() == 2
    assert assess(docs.limit(0)).count() == 0


def test_documents_that_share_several_template_lines_count_each(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(15))
    rows = [(i, f"site header line\n{own(i)}\nsite footer line\nabout us contact", "a") for i in range(30)]  # one own line, three template lines
    rows += [(100 + i, f"{own(500)}\nlegal notice line\n{own(501)}", "b") for i in range(1000)]  # a template document copied 1000 times
    rows += [(2000 + i, f"{own(600 + i)}\nlegal notice line", "b") for i in range(11)]
    rows += [(3000 + i, "only a lonely line", "c") for i in range(40)]  # copies of one line
    got = {r.doc_id: r for r in assess(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].removed == [0, 2, 3] and got[i].kept for i in range(30))
    assert all(got[100 + i].removed == [1] for i in range(1000)) and all(got[2000 + i].removed == [1] for i in range(11))
    assert all(got[3000 + i].removed == [] for i in range(40))
