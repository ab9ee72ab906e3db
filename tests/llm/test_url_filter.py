import math
import random
from collections import defaultdict

import duckdb

from talkweave.llm.q_url import RULES, SQL
from talkweave.llm.url_filter import judge, levels


def fixture():
    g = random.Random(5)
    rows = []
    for i in range(600):
        host = g.choice(["a.example.com", "b.example.com", "c.shop.com", "www.example.org", "example.org", "x.y.example.org", "z.example.net", "only.de.com", "only.de.com"])
        lang = "de" if host == "only.de.com" and g.random() < 0.8 else g.choice(["fr", "de", "en", "es"])
        rows.append((i, f"https://{host}/{lang}/{g.randint(1, 30)}?page=1", "x"))
    rows += [(None, "http://A.Example.COM/fr/1", "x"), (1000, None, "x"), (1001, "no scheme", "x"), (1002, "", "x"), (1003, "http://", "x"), (1004, "http://org", "x"), (1005, "http://org/", "x"), (1006, "http://myorg/", "x")]
    rows += [(1007, "http://É.ÉXAMPLE.org/es/1#a?b", "x"), (1008, "http://u@a.example.com:80/de/2", "x"), (1009, "http://1.2.3.4/de/", "x"), (1010, "a://b://c/fr/", "x"), (1011, "http://shop.co.uk./en", "x"), (1012, "http://example.org/en/1?x", "x")]
    rows += [(1013, "http://www.example.com?q=/fr/", "x"), (1014, "http://h.com/fr/\nnext?x", "x"), (1015, "http://" + "a." * 5000 + "com/de/" + "p" * 10000, "x"), (0, "https://b.example.com/en/1", "x")]
    return rows


def brute(rows):
    t = []
    for i, url, _ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for r, v in RULES if (host == r[: r.find("/")] or host.endswith("." + r[: r.find("/")])) and path.startswith(r[r.find("/") :])]
        t.append((i, host, path, *(max(fits)[1:] if fits else (None, None))))
    count = lambda key: {g: (sum(x[4] is not None for x in t if key(x[1]) == g), sum(x[4] == "allow" for x in t if key(x[1]) == g)) for g in {key(x[1]) for x in t}}

    def dom(h):
        b = h.split("@")[-1].split(":")[0].removesuffix(".")
        if "." not in b or all(c in "0123456789." for c in b):
            return b
        return ".".join(b.split(".")[-3 if b.endswith("co.uk") else -2 :])

    suf = lambda h: dom(h) if "." not in dom(h) or dom(h)[0].isdigit() else dom(h).split(".", 1)[1]
    up = {h: (dom(h), suf(h)) for h in {x[1] for x in t}}

    def shrink(groups, prior):
        over = sum((k - n * prior[g]) ** 2 - n * prior[g] * (1 - prior[g]) for g, (n, k) in groups.items() if n > 1)
        all_ = sum(n * (n - 1) * prior[g] * (1 - prior[g]) for g, (n, k) in groups.items() if n > 1)
        s = 1 / (min(max(over / all_, 0.001), 0.999) if all_ else 0.5) - 1
        return {g: ((k + s * prior[g]) / (n + s), n + s) for g, (n, k) in groups.items()}

    labelled = [x for x in t if x[4]]
    m = (sum(x[4] == "allow" for x in labelled) + 1) / (len(labelled) + 2)
    s1 = shrink(count(suf), defaultdict(lambda: m))
    d1 = shrink(count(dom), {d: s1[s][0] for d, s in up.values()})
    h1 = shrink(count(lambda h: h), {h: d1[d][0] for h, (d, _) in up.items()})
    high = {h: r + 1.28 * math.sqrt(r * (1 - r) / (n + 1)) for h, (r, n) in h1.items()}
    return [(i, h, p, r, v or ("block" if high[h] < 0.5 and count(dom)[dom(h)][0] else "allow")) for i, h, p, r, v in t]


KEY = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


def test_equals_brute_force_and_sql(spark):
    rows = fixture()
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").repartition(3)
    got = sorted((tuple(r)[:5] for r in judge(pages, RULES).collect()), key=lambda r: (repr(r[0]), r[1:3]))
    assert got == sorted(brute(rows), key=lambda r: (repr(r[0]), r[1:3]))
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    assert sorted(con.execute(SQL).fetchall(), key=lambda r: (repr(r[0]), r[1:3])) == got
    by_host = defaultdict(set)
    for _, host, _, rule, verdict in got:
        if rule is None:
            by_host[host].add(verdict)
    assert by_host["only.de.com"] == {"block"} and by_host["z.example.net"] == {"allow"}


def test_own_outcomes_and_no_outcomes(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.site.com/{i}", i % 2 == 0) for i in range(40)] + [(40 + i, f"http://{h}.site.com/new", None) for i, h in enumerate(("bad", "good", "unseen"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    got = {r.page_id: r for r in judge(pages, [], F.col("good")).collect()}
    assert (got[40].verdict, got[41].verdict, got[42].verdict) == ("block", "allow", "allow")
    assert got[41].reputation > 0.9 > got[42].reputation > 0.4 > 0.1 > got[40].reputation
    unlabelled = judge(pages.drop("good"), []).collect()
    assert {(r.verdict, r.reputation) for r in unlabelled} == {("allow", 0.5)}
    assert judge(pages.limit(0), RULES).count() == 0


def test_levels(spark):
    d = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("localhost",), ("10.0.0.1:80",), ("x@b.com.",), ("",), ("[::1]",)], "h string")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in d.select(*levels(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.com", "com"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("b.com", "com"), ("", ""), ("[::1]", "[::1]")]
