import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from talkweave.llm.divergence import audit
from talkweave.llm.q_divergence import SQL

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    groups, counts, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        found = TERM.findall((text or "").translate(LOWER))
        counts[g].update(found)
        docs[g[0]].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted((s for la, s in groups if la == lang), key=lambda s: s.encode())
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def fixture():
    g = random.Random(3)
    words = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)] + ["Élan", "élan", "Straße", "日本語", "Ab"]
    rows = []
    for i in range(900):
        source = g.choice(["s1", "s2", "s3", "Z", "é"]) if i % 3 else "hot"
        text = " ".join(g.choice(words[: 20 + 17 * len(source)]) for _ in range(g.randint(0, 30)))
        rows.append((text + "," + text.upper() + "_x9y" * (i % 2), g.choice(["en", "en", "fr", None]), source if i % 50 else None))
    rows += [("only here", "xx", "alone"), (None, "en", "empty"), ("", "fr", "empty"), ("1234", "yy", "a"), ("word", "yy", "b"), ("a\x00b \x7f`{ÿ", "en", "s1")] + [("same", "zz", s) for s in "ab" for _ in range(20)]
    return rows + [("long " * 30000, "en", "s2"), ("x" * 300000, "en", "s2")]


@pytest.mark.parametrize(("shard_rows", "salt_groups"), [(400_000, 64), (40, 3)])
def test_equals_brute_force_and_sql(spark, shard_rows, salt_groups):
    rows = fixture()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int").repartition(3)
    got = audit(docs, shard_rows=shard_rows, salt_groups=salt_groups)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert {r[0] for r in want} == {"", "en", "fr", "yy", "zz"} and ("yy", "a", "pair", "b", 0, 1) in want
    if salt_groups == 64:
        con = duckdb.connect()
        con.register("documents", docs.toArrow())
        assert sorted(con.execute(SQL).fetchall()) == want


def test_chunks_and_empty(spark):
    from talkweave.llm.divergence import term_counts

    rows = [(f"a b{'x' * (i % 7)} a", "en", f"s{i % 3}") for i in range(200)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    sums = lambda d: sorted(tuple(r) for r in d.groupBy("lang", "source", "term").agg({"n": "sum", "docs": "sum"}).collect())
    assert sums(term_counts(docs, chunk_bytes=1)) == sums(term_counts(docs, chunk_bytes=20)) == sums(term_counts(docs))
    assert audit(docs.limit(0)).count() == 0
