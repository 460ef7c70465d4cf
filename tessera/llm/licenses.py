"""Licence scans by the Dice coefficient over word bigrams.

Texts and templates (notices, file headers, whole licence texts) are normalised to words: lower case, all but letters
and digits separate. Line ends, comment marks and what shares the line do not matter. The coefficient counts bigrams
with their repeats: ``2 * common / (window + template)``.

A bigram that a template has once, found in a text, says where the template would start and end there. The windows
compared with a template are all those from such a start to such an end whose size allows the threshold ``t``:
``t / (2 - t) <= window / template <= (2 - t) / t``.

1. Every bigram of a text that some template has is a match, with its position.
2. A window that reaches the threshold holds at least ``t / (2 - t)`` of the template, so it has one of the template's
   rarest bigrams, counted over all documents: an inverted index of those gives the candidate templates of a text.
3. Two neighbouring stretches of a window's greatest size must hold that many matches together, or no window starts
   in the first.
4. Starts, ends and matches meet by such stretches, never all with all of a text, and the common bigrams are counted.

Documents of equal text are worked on once (their key is two 64-bit hashes of the text). The bigrams of the templates
are broadcast while the templates' texts are below a stated size; else Spark joins them by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_table

# Public licence notices, file headers and texts, by SPDX id.
TEMPLATES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "notice", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "notice",
     "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MPL-2.0", "notice",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "notice", "All rights reserved."),
    ("Apache-2.0", "header", """
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""),
    ("GPL-2.0", "header", """
This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""),
    ("GPL-3.0", "header", """
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""),
    ("MPL-2.0", "header", """
This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""),
    ("MIT", "text", """
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""),
    ("ISC", "text", """
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""),
    ("BSD-2-Clause", "text", """
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""),
    ("BSD-3-Clause", "text", """
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""),
]
THRESHOLD = 0.8
# The templates' bigrams are broadcast while their texts have at most so many characters.
BROADCAST = 4 << 20
KEY = ["k1", "k2"]
# A template is known by its licence and form.
NAME = ["license", "form"]
ALL = 1 << 30
# Sizes are products of whole numbers and the threshold; this keeps 12.000000000000002 at 12.
SLACK = 1e-9


def words(text: Column) -> Column:
    """The words of a text: stretches of letters and digits, in lower case; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def text_key(text: Column) -> list[Column]:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), whole).alias("k1"), F.xxhash64(F.lit(2), whole).alias("k2")]


def bigrams(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys``, ``size`` (number of bigrams of the text), ``pos``, ``a`` and ``b``, a row per bigram."""
    held = rows.select(*keys, words(text).alias("w")).filter(F.size("w") > 1)
    pairs = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, ALL).alias("b"))
    return held.select(*keys, (F.size("w") - 1).alias("size"), F.posexplode(pairs).alias("pos", "p")).select(
        *keys, "size", "pos", "p.a", "p.b")


class Templates:
    """``grams`` (gram, a, b) and ``postings``: per template and gram its count, its offset if it occurs once, the
    template's ``total`` of bigrams and the bounds ``low`` and ``high`` of a window. Equal names are refused."""

    def __init__(self, spark: SparkSession, templates: list[tuple[str, str, str]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies above 0 and up to 1")
        if not templates or len({t[:2] for t in templates}) < len(templates):
            raise ValueError("templates need different names")
        self.small = sum(len(body) for *_, body in templates) <= BROADCAST
        rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip((*NAME, "body"), t, strict=True)])
                         for t in templates])
        known = bigrams(spark.range(1).select(F.explode(rows).alias("t")).select("t.*"), NAME, F.col("body"))
        known = known.groupBy(*NAME, "size", "a", "b").agg(F.count(F.lit(1)).cast("int").alias("count"),
                                                           F.min("pos").alias("first"))
        known = shared_table(known, "license_bigrams")
        self.grams = shared_table(known.select("a", "b").distinct()
                                  .withColumn("gram", F.monotonically_increasing_id()), "license_grams")
        self.postings = shared_table(known.join(self.grams, ["a", "b"]).select(
            *NAME, "gram", "count", F.when(F.col("count") == 1, F.col("first")).alias("offset"),
            F.col("size").alias("total"),
            F.ceil(F.col("size") * threshold / (2 - threshold) - SLACK).cast("int").alias("low"),
            F.floor(F.col("size") * (2 - threshold) / threshold + SLACK).cast("int").alias("high")), "license_postings")

    def sized(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def _candidates(found: DataFrame, known: Templates) -> DataFrame:
    """``found`` with the postings of those templates of which the text has a bigram that a window cannot be without."""
    rarity = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = known.postings.join(rarity, "gram", "left")
    commonest = Window.partitionBy(*NAME).orderBy(F.coalesce("n", F.lit(0)).desc(), "gram")
    # the commonest bigrams that together stay below the least common part are not enough for a window
    ranked = ranked.withColumn("sum", F.sum("count").over(commonest)).filter(F.col("sum") >= F.col("low"))
    index = shared_table(ranked.select("gram", *NAME), "license_index")
    pairs = found.join(known.sized(index), "gram").select(*KEY, *NAME).distinct()
    near = found.join(pairs, KEY).join(known.sized(known.postings), [*NAME, "gram"])
    return shared_table(near.withColumn("stretch", F.floor(F.col("pos") / F.col("high"))), "license_matches")


def _windows(near: DataFrame) -> DataFrame:
    """``start`` and ``end`` (bigram numbers, end exclusive) of the windows to compare, by text and template."""
    of = [*KEY, *NAME]
    counts = near.groupBy(*of, "low", "stretch").agg(F.count(F.lit(1)).alias("n"))
    # a window lies in the stretch of its start and the next one
    dense = counts.select(*of, "low", "n", F.explode(F.array(F.col("stretch"), F.col("stretch") - 1)).alias("stretch"))
    dense = dense.groupBy(*of, "low", "stretch").agg(F.sum("n").alias("n")).filter("n >= low").select(*of, "stretch")
    shift = near.filter("offset IS NOT NULL").select(
        *of, "size", "total", "low", "high", (F.col("pos") - F.col("offset")).alias("shift")).distinct()
    starts = shift.withColumn("start", F.greatest("shift", F.lit(0))) \
                  .withColumn("stretch", F.floor(F.col("start") / F.col("high"))) \
                  .select(*of, "total", "low", "high", "start", "stretch").distinct().join(dense, [*of, "stretch"])
    starts = starts.withColumn("stretch", F.explode(F.array(F.col("stretch"), F.col("stretch") + 1)))
    ends = shift.withColumn("end", F.least(F.col("shift") + F.col("total"), F.col("size"))) \
                .select(*of, "end", F.floor(F.col("end") / F.col("high")).alias("stretch")).distinct()
    size = F.col("end") - F.col("start")
    return starts.join(ends, [*of, "stretch"]).filter(size.between(F.col("low"), F.col("high"))).select(
        *of, "total", "high", "start", "end")


def _best(found: DataFrame) -> DataFrame:
    """``found`` with ``best``: the windows chosen if the highest are chosen first and none shares a word with one
    chosen before.

    Windows rank by the number of common bigrams less the others in them, so that a whole header goes before the exact
    notice inside it; then by dice, start and name. A round chooses those that rank first at all their words and drops
    those that share one with them, so the rounds follow the longest rising chain of windows, mostly one or two.
    """
    score = 2 * F.col("common") - (F.col("end") - F.col("start"))
    order = F.struct((-score).alias("s"), (-F.col("dice")).alias("d"), "start", "end", *NAME)
    columns = [*KEY, *NAME, "start", "end", "common", "dice"]
    here = Window.partitionBy(*KEY, "word")
    done, left = None, found
    while True:
        each = left.withColumn("order", order).withColumn("word", F.explode(F.sequence("start", "end")))
        each = each.withColumn("first", F.col("order") == F.min("order").over(here))
        best = each.groupBy(*columns).agg(F.every("first").alias("best"))
        each = best.withColumn("word", F.explode(F.sequence("start", "end")))
        each = each.withColumn("taken", F.max("best").over(here))
        ruled = shared_table(each.groupBy(*columns, "best").agg(F.some("taken").alias("decided")), "license_ranks")
        decided = ruled.filter("decided").drop("decided")
        done = decided if done is None else done.unionByName(decided)
        left = ruled.filter("NOT decided").select(*columns)
        if left.isEmpty():
            return done


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str, str]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` and window that reaches the threshold: doc_id, start and end (word numbers, end exclusive),
    license, form, dice, and best: whether the window is chosen when those are chosen first that have most common
    bigrams less other ones (then by dice, start and name), and none that shares a word with a chosen one.

    Null and empty texts and those of one word have no rows, nor have templates of one word; repeated rows are all
    scanned; an empty table gives no rows; other columns are not read.
    """
    known = Templates(docs.sparkSession, templates or TEMPLATES, threshold)
    rows = bigrams(docs.select(*text_key(F.col(text)), F.col(text).alias("text")), KEY, F.col("text"))
    found = shared_table(rows.join(known.sized(known.grams), ["a", "b"]).select(
        *KEY, "size", "pos", "gram").distinct(), "license_hits")
    near = _candidates(found, known)
    of = [*KEY, *NAME]
    windows = _windows(near)
    first = F.floor(F.col("start") / F.col("high"))
    windows = windows.withColumn("stretch", F.explode(F.array(first, first + 1))).drop("high")
    inside = windows.join(near.select(*of, "stretch", "pos", "gram", "count"), [*of, "stretch"]).filter(
        (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    common = inside.groupBy(*of, "total", "start", "end", "gram", "count").agg(F.count(F.lit(1)).alias("n")) \
                   .groupBy(*of, "total", "start", "end").agg(F.sum(F.least("n", "count")).alias("common"))
    dice = 2 * F.col("common") / (F.col("end") - F.col("start") + F.col("total"))
    alike = shared_table(common.withColumn("dice", dice).filter(F.col("dice") >= threshold)
                         .select(*of, "start", "end", "common", "dice"), "license_windows")
    best = shared_table(_best(alike), "licenses")
    return docs.select(F.col(doc_id), *text_key(F.col(text))).join(best, KEY).select(
        doc_id, F.col("start").cast("int").alias("start"), (F.col("end") + 1).cast("int").alias("end"), *NAME, "dice",
        "best")
