import math
import os
import re
import textwrap
from collections import Counter

import duckdb
import pytest

from talkweave.llm.license_scan import TEMPLATES, TITLES, scan
from talkweave.llm.q_license import SQL, place


def words(t):
    return [w for w in re.split("[^a-z0-9]+", t.lower()) if w]


def brute(rows, least=0.6):
    names = sorted(TEMPLATES) + sorted(TITLES)
    counts = [Counter(words(t)) for _, t in names]
    known, spoken = set().union(*counts), set().union(*counts[: len(TEMPLATES)])
    lines = [w for _, _, t in rows for x in (t or "").split("\n") if (w := words(x))]
    q = lambda w: (math.log((len(lines) + 1) / (sum(w in x for x in lines) + 1)) + 1) ** 2
    weight = {w: q(w) for w in known}
    most = (math.log(len(lines) + 1) + 1) ** 2
    own = []
    for _, path, t in rows:
        mine = [w for x in (t or "").split("\n") if (w := words(x))]
        near = [2 * len(set(x) & spoken) >= len(set(x)) for x in mine]
        segments, run = [(0, x) for x, n in zip(mine, near) if n], []
        for x, n in zip([*mine, []], [*near, False]):
            if n:
                run += x
            elif run:
                segments.append((1, run))
                run = []
        named = path is not None and bool(re.match(r"(?i)(licen[sc]e|copying|notice|unlicense)([.-].*)?$", path.rsplit("/", 1)[-1]))
        if named and mine:
            segments += [(2, [w for x in mine for w in x]), (3, mine[0]), (3, [w for x in mine[:2] for w in x])]
        best = None
        for kind, x in segments:
            x = Counter(x)
            size = math.sqrt(sum(weight.get(w, most) * n * n for w, n in x.items()))
            for k, s in enumerate(counts):
                c = round(sum(weight[w] * n * x[w] for w, n in s.items()) / (size * math.sqrt(sum(weight[w] * n * n for w, n in s.items()))), 4)
                if (kind == 3) == (k >= len(TEMPLATES)) and c >= (0.9 if kind == 3 else least):
                    best = max(best or (kind, c, -k), (kind, c, -k))
        own.append((named, best and best[1:]))
    out = []
    for (i, path, _), (_, b) in zip(rows, own, strict=True):
        name, origin = (names[-b[1]][0], None) if b else (None, None)
        d = path.rpartition("/")[0] if path is not None else None
        up = d
        while not b and up is not None:
            here = [c for (_, p, _), (n, c) in zip(rows, own, strict=True) if n and c and p.rpartition("/")[0] == up]
            if here:
                name, origin = names[-max(here)[1]][0], up
                break
            up = up.rpartition("/")[0] if up else None
        out.append((i, path, names[-b[1]][0] if b else None, b[0] if b else None, name, origin))
    return out


ROWS = [
    (1, "/a/LICENSE", "Released under the MIT License.\n"),
    (2, "/a/b/c/x.py", "code here and the rest of it\nmore words of text"),
    (3, "/a/b/LICENSE.txt", "Licensed under the Apache License,\nVersion 2.0."),
    (4, "/a/b/c/y.py", "# licensed under the Apache License, Version 2.0\ncode"),
    (5, "/a/z.py", "x " * 5000 + "\nnothing"),
    (6, None, None),
    (7, "/q/r.py", "All rights reserved."),
    (8, "top.py", "plain"),
    (9, "/q/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (9, "/q/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (10, "/q/NOTICE", "Released under the MIT License."),
    (11, "/q/deep/er/file", ""),
    (12, "/a/b/c/y.py", "under the license of a friend of mine who licensed nothing at all to anyone"),
    (None, "/a/b/notes", "the the the"),
]

full = {n: max((t for m, t in TEMPLATES if m == n), key=len) for n, _ in TEMPLATES}
wrapped = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 60))
ROWS += [
    (20, "/w/a.py", "#!/usr/bin/env python\n" + wrapped(full["Apache-2.0"], "# ") + "\n\nimport os\nprint(os.getcwd(), flush=True)"),
    (21, "/w/LICENSE", "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n" + wrapped(full["BSD-3-Clause"]).replace(" 3. ", "\n\n3. ")),
    (22, "/w/b.c", wrapped(full["GPL-3.0"], " * ") + "\nint main(void) { return 0; }"),
    (23, "/w/v/c.c", "int f(void);"),
    (24, "/m/license.md", "MIT License\n\nCopyright (c) 2021 Any One\n\n" + wrapped(full["MIT"])),
]


def test_full_texts_and_wrapped_headers(spark):
    files = spark.createDataFrame(ROWS, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in scan(files).collect()}
    assert [got[i].license for i in range(20, 25)] == ["Apache-2.0", "BSD-3-Clause", "GPL-3.0", "BSD-3-Clause", "MIT"]
    assert got[23].inherited_from == "/w" and all(0.8 < got[i].own_score < 1 for i in (21, 24))


ROWS += [
    (30, "/t/LICENSE", "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999\n\nCopyright (C) 1991, 1999 Free Software Foundation, Inc.\n" + wrapped(full["LGPL-3.0"])),
    (31, "/t/a.c", "int g(void);"),
    (32, "/u/COPYING", "CC0 1.0 Universal\n\nStatement of Purpose\n" + "the laws of most jurisdictions confer exclusive rights\n" * 30),
]


def test_titles_tell_the_versions(spark):
    """Files that open like the long licences, their bodies made of words that several of them share."""
    body = wrapped(" ".join(full[n] for n in ("GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Apache-2.0")))
    rows = [(k, f"/{k}/LICENSE", t.replace(" Version", "\n  Version") + "\n\n" + body) for k, (_, t) in enumerate(TITLES)]
    rows += [(100 + k, f"/{k}/src/x.c", "int f(void);") for k in range(len(TITLES))]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, (name, _) in enumerate(TITLES):
        assert (got[k].own_license, got[100 + k].license) == (name, name) and got[k].own_score > 0.9


COMMON = "/usr/share/common-licenses"
TEXTS = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="the system has no licence texts")
def test_whole_licence_texts_of_the_system(spark):
    found = {f: n for f, n in TEXTS.items() if os.path.isfile(f"{COMMON}/{f}")}
    rows = [(k, f"/{f}/LICENSE", open(f"{COMMON}/{f}", encoding="utf-8", errors="replace").read()) for k, f in enumerate(found)]
    got = {r.doc_id: (r.own_license, r.own_score > 0.9) for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {k: (n, True) for k, n in enumerate(found.values())}


def test_equals_brute_force(spark):
    files = spark.createDataFrame([(*r, 0.5) for r in ROWS], "doc_id long, path string, text string, score double").repartition(3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(map(tuple, scan(files).collect()), key=key)
    assert got == sorted(brute(ROWS), key=key)
    by = {r[0]: r for r in got}
    assert by[2][4:] == ("Apache-2.0", "/a/b") and by[5][4:] == ("MIT", "/a") and by[4][2] == "Apache-2.0"
    assert scan(files.limit(0)).count() == 0


def test_sql_gives_the_same(spark):
    texts = [t for _, _, t in ROWS]
    rows = [(i, texts[i % len(texts)], f"s{i % 3}") for i in [*range(0, 1300, 7), 0, 100, 1000, 1001, 1002, 1003]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in scan(docs.withColumn("path", place())).collect()]
    assert sorted(con.execute(SQL).fetchall(), key=key) == sorted(got, key=key)
    assert any(r[5] for r in got)
