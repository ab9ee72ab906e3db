"""Licence scans: sparse TF-IDF cosine to licence templates, and inheritance along directories.

DataFrame operations only. A line is licence-like if at least half of its distinct tokens are some template's.
Each licence-like line is compared with every template, and so is each run of licence-like lines that
follow one another (blank lines aside), as headers are wrapped; files named like a licence are compared as
a whole too. A segment's vector has one entry for each token, its number there times its inverse document
frequency over all lines of the corpus; tokens that no template has weigh as much as one seen never. Only
licence-like lines and licence files are exploded into tokens.

The long licences are told, with their versions, by their titles: the first line of a licence file, and its first two, are
compared with the titles alone, at a higher limit. A title counts before a whole file's template, that before a run's,
and a run's before a single line's: a licence text whose second line is "All rights reserved." is what the whole says.

A file without a licence of its own takes that of the nearest directory above it that holds a licence
file, by a join on the directories of its path. Directories near the root are hot keys: that join
deals both sides anew, so that adaptive execution can split them. What is broadcast is the token
table of the templates alone.

Defined results: a null text has no licence; a null path has no directory, so nothing is inherited;
of templates with the same cosine the first by name counts, of several licence files in a directory
the one of highest cosine, then first by name; rows that repeat get equal results; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import durable, spread_join

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see https://www.gnu.org/licenses/."


# The wording of public licences and of their headers, and the notices by which they are commonly named.
TEMPLATES = [
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", f"{_FORMS} {_HOLDERS}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", f"{_FORMS} {_ENDORSE} {_HOLDERS}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0 Universal."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("GPL-2.0", _gnu("GNU General Public License", "2")),
    ("GPL-2.0", "Licensed under the GNU General Public License version 2"),
    ("GPL-3.0", _gnu("GNU General Public License", "3")),
    ("GPL-3.0", "Licensed under the GNU General Public License version 3"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3")),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License version 3"),
    ("MIT", f"{_PERMISSION} {_AS_IS}"),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. {_AS_IS}"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("proprietary", "All rights reserved."),
]
# The titles of licence texts, as they open them.
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EUPL-1.2", "European Union Public Licence v. 1.2"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
LICENCE_FILE = "^(?i)(licen[sc]e|copying|notice|unlicense)([.-].*)?$"


LINE, RUN, WHOLE, TITLE = 0, 1, 2, 3


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def corpus_weights(lines: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[dict[str, int]]]:
    """(squared weight of each token of the templates, that of any other token, counts of each template's tokens).

    lines: a column `x` of token arrays. What reaches the driver is one count for each token of the templates."""
    spark = lines.sparkSession
    own = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(templates)], "k int, text string").select("k", tokens(F.col("text")).alias("t"))
    counts = [dict(Counter(r["t"])) for r in own.orderBy("k").collect()]
    held = F.array_intersect(vocabulary(set().union(*counts)), "x")
    seen = lines.filter(F.size("x") > 0).select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()  # "" counts the lines
    df = {r["w"]: r["count"] for r in seen}
    n = df.get("", 0)
    squared = lambda k: (math.log((n + 1) / (k + 1)) + 1) ** 2
    return {w: squared(df.get(w, 0)) for w in sorted(set().union(*counts))}, squared(0), counts


def vocabulary(words: set[str]) -> Column:
    return F.array(*(F.lit(w) for w in sorted(words)))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.6, titles: list[tuple[str, str]] = TITLES, least_title: float = 0.9) -> DataFrame:
    """doc_id, path, own_license, own_score (4 decimals), license, inherited_from (a directory): one row for each row of files."""
    spark, whole = files.sparkSession, len(templates)
    templates = [*sorted(templates), *sorted(titles)]
    d = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    squares, other, counts = corpus_weights(d.select(F.explode(F.split("text", "\n")).alias("line")).select(tokens(F.col("line")).alias("x")), templates)
    norms = [math.sqrt(sum(squares[w] * n * n for w, n in t.items())) for t in counts]
    weights = spark.createDataFrame([(w, q, {k: t[w] for k, t in enumerate(counts) if w in t}) for w, q in squares.items()], "w string, q double, has map<int, int>")

    named = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))
    d = d.withColumn("lines", F.filter(F.transform(F.split("text", "\n"), tokens), lambda x: F.size(x) > 0))
    like = lambda x: 2 * F.size(F.array_intersect(vocabulary(set().union(*counts[:whole])), x)) >= F.size(F.array_distinct(x))
    d = d.withColumn("near", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.when(like(x), x).alias("x"))), lambda s: s["x"].isNotNull()))
    part = lambda kind, at, x: F.struct(F.lit(kind).alias("kind"), at.alias("at"), x.alias("x"))
    # Licence-like lines that follow one another have the same distance to their rank.
    segments = F.concat(
        F.transform("near", lambda s: part(LINE, s["at"], s["x"])),
        F.transform("near", lambda s, i: part(RUN, s["at"] - i, s["x"])),
        F.when(named & (F.size("lines") > 0), F.array(part(WHOLE, F.lit(0), F.flatten("lines")), *(part(TITLE, F.lit(n), F.flatten(F.slice("lines", 1, n))) for n in (1, 2)))).otherwise(F.array().cast("array<struct<kind: int, at: int, x: array<string>>>")),
    )
    d = d.select(F.monotonically_increasing_id().alias("row"), F.struct("doc_id", "path", named.alias("named")).alias("file"), segments.alias("segments"))
    d = d.select("row", "file", F.explode_outer("segments").alias("s")).select("row", "file", "s.kind", "s.at", F.explode_outer("s.x").alias("w")).groupBy("row", "kind", "at", "w").agg(F.first("file").alias("file"), F.count("*").alias("tf"))
    d = d.join(F.broadcast(weights), "w", "left")
    dots = [F.sum(F.col("tf") * F.col("q") * F.col("has")[k]).alias(f"dot{k}") for k in range(len(templates))]
    per = d.groupBy("row", "kind", "at").agg(F.first("file").alias("file"), F.sum(F.col("tf") * F.col("tf") * F.coalesce("q", F.lit(other))).alias("own"), *dots)
    each = [F.struct(F.round(F.coalesce(F.col(f"dot{k}") / (F.sqrt("own") * norms[k]), F.lit(0.0)), 4).alias("score"), F.lit(-k).alias("k")) for k in range(len(templates))]
    title = F.col("kind") == TITLE
    per = per.withColumn("best", F.when(title, F.array_max(F.array(*each[whole:]))).otherwise(F.array_max(F.array(*each[:whole]))) if titles else F.array_max(F.array(*each)))
    best = F.max(F.when((F.col("best.score") >= F.when(title, least_title).otherwise(least)) & F.col("kind").isNotNull(), F.struct("kind", "best.score", "best.k"))).alias("best")
    own = per.groupBy("row").agg(F.first("file").alias("file"), best)
    own = durable(own.select("row", "file.*", F.col("best.score").alias("score"), F.col("best.k").alias("k"), F.split(F.regexp_extract("file.path", "^(.*)/[^/]*$", 1), "/").alias("parts")))

    holders = own.filter(F.col("named") & F.col("k").isNotNull()).groupBy(F.array_join("parts", "/").alias("dir")).agg(F.max(F.struct("score", "k")).alias("best")).select("dir", F.col("best.k").alias("from_k"))
    lacking = own.filter(F.col("k").isNull() & F.col("path").isNotNull()).select("row", "parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    above = lacking.select("row", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir")).distinct()
    nearest = spread_join(above, holders, "dir", "inner").groupBy("row").agg(F.max(F.struct("depth", "dir", "from_k")).alias("up"))
    name = F.array(*(F.lit(n) for n, _ in templates))
    out = own.join(nearest, "row", "left")
    return out.select("doc_id", "path", F.get(name, -F.col("k")).alias("own_license"), F.col("score").alias("own_score"), F.get(name, -F.coalesce("k", "up.from_k")).alias("license"), F.col("up.dir").alias("inherited_from"))
