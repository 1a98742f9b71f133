"""License scans by diagonal voting.

All word k-grams of the documents are joined, by hash, with those of the license templates. A match votes for the diagonal
(place in the document less place in the template) of its document and template. Votes are gathered per diagonal, diagonals
that are close are merged, as a word more or less shifts the rest of a copy by one; a longer chain than the template is judged
by its best diagonal. Chains with enough k-grams are verified by their words: along its diagonals, the document's words are
compared with the template's. A span stands if it holds SHARE of the template's words, or, so that parts of a license are found
too, at least PART words that are ALONG of the template's words between its ends. Its coverage is its share of the template.

Base labels come from phrases that stand in the words, whatever the templates find. The score is the best coverage, and MENTION
at least where a phrase stands, which alone says little. The longest licenses are known by the notices that go with them, which
their full texts also hold.

Native: DataFrame functions only. The templates are a fixed, small set and are broadcast. Of the texts only those with a chain
to verify are read again, where they lie or in a join (see common.parted).

A null text has no words. Rows are judged each for themselves, whatever their doc_id, which may be null or repeated. Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftflow.llm.common import literal_rows, numbered, parted, word_array, written

GRAM = 3
#: Diagonals at most so far apart are merged; a chain may be so much longer than its template.
DRIFT, STRETCH = 4, 1.5
#: What verifies a span, see above.
SHARE, PART, ALONG = 0.6, 20, 0.8
MENTION = 0.2
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
#: label, text: whole licenses, notices, and license names as notices write them.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If
not, see <https://www.gnu.org/licenses/>."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License
along with this library"""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License
along with this program"""),
    ("bsd", f"{_BSD} {_AS_IS}"),
    ("bsd", f"""{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. {_AS_IS}"""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
]


def template_words(spark: SparkSession, templates) -> DataFrame:
    t = literal_rows(spark, [(i, label, text) for i, (label, text) in enumerate(templates)], "tid int, label string, text string")
    return t.select("tid", "label", word_array(F.col("text")).alias("tw")).withColumn("len", F.size("tw"))


def gram_places(words: DataFrame, key: str, w: str, k: int) -> DataFrame:
    """(key, pos, h) of every k-gram of the words in the array w."""
    hashed = F.expr(f"xxhash64({', '.join([*(f'{w}[pos + {j}]' for j in range(k - 1)), 'word'])})")
    return words.where(F.size(w) >= k).select(key, w, F.posexplode(F.expr(f"slice({w}, {k}, size({w}))")).alias("pos", "word")).select(key, "pos", hashed.alias("h"))


def license_spans(rows: DataFrame, templates=TEMPLATES, k: int = GRAM, drift: int = DRIFT, share: float = SHARE, part: int = PART, along: float = ALONG) -> DataFrame:
    """(row, label, start, stop, coverage) in words, of (row, text): the verified spans."""
    spark = rows.sparkSession
    known = template_words(spark, templates)
    grams = gram_places(known, "tid", "tw", k).withColumnRenamed("pos", "tpos")
    need = grams.groupBy("tid").agg(F.count_distinct("h").alias("need"))
    places = gram_places(rows.select("row", word_array(F.col("text")).alias("w")), "row", "w", k)
    votes = places.join(F.broadcast(grams), "h").withColumn("d", F.col("pos") - F.col("tpos"))
    # a diagonal crosses each place of a template once, so its set of k-grams is no larger than the template
    lines = votes.groupBy("row", "tid", "d").agg(F.collect_set("h").alias("hs"), F.min("pos").alias("a"), (F.max("pos") + k).alias("b"))
    by = Window.partitionBy("row", "tid").orderBy("d")
    chain = lines.withColumn("new", F.coalesce(F.col("d") - F.lag("d").over(by) > drift, F.lit(True)).cast("int")).withColumn("c", F.sum("new").over(by))
    one = F.struct(F.size("hs").alias("n"), (-F.col("a")).alias("first"), "d", "a", "b")
    merged = chain.groupBy("row", "tid", "c").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hs")))).alias("n"), F.min("a").alias("start"), F.max("b").alias("stop"), F.collect_list(F.struct("d", "a", "b")).alias("segments"), F.max(one).alias("one"))
    sized = merged.join(F.broadcast(known.join(need, "tid")), "tid")
    long = F.col("stop") - F.col("start") > STRETCH * F.col("len") + drift
    best = F.array(F.struct("one.d", "one.a", "one.b"))
    sized = sized.select("row", "tid", F.when(long, F.col("one.n")).otherwise(F.col("n")).alias("n"), F.when(long, best).otherwise(F.col("segments")).alias("segments"), "need")
    maybe = written(sized.where((F.col("n") >= share * F.col("need")) | (F.col("n") > part - k)).select("row", "tid", "segments"), "chains")
    texts = parted(rows.select("row", "text"), maybe, "row")[0].select("row", word_array(F.col("text")).alias("w"))
    asked = texts.join(maybe, "row").join(F.broadcast(known), "tid")
    # the places of the template whose word stands at its diagonal's place in the document
    found = asked.withColumn("held", F.expr("array_distinct(flatten(transform(segments, s -> filter(sequence(s.a - s.d, s.b - s.d - 1), i -> w[i + s.d] = tw[i]))))"))
    found = found.withColumn("n", F.size("held")).withColumn("between", F.array_max("held") - F.array_min("held") + 1).withColumn("coverage", F.col("n") / F.col("len"))
    stands = (F.col("coverage") >= share) | ((F.col("n") >= part) & (F.col("n") >= along * F.col("between")))
    return found.where(stands).select("row", "label", F.array_min("segments.a").alias("start"), F.array_max("segments.b").alias("stop"), "coverage")


def base_places(words: Column, phrases=BASE) -> Column:
    """array<struct<at, label>> of the places where a phrase's words stand, unordered."""

    def places(phrase: list[str], label: str) -> Column:
        def start(x, i):
            ok = x == phrase[-1]
            for j, w in enumerate(reversed(phrase[:-1]), 1):
                ok = ok & (i >= j) & (F.get(words, i - j) == w)
            return F.when(ok, i - len(phrase) + 1)

        # few documents hold a phrase's last word; the others skip the walk through their words
        at = F.when(F.array_contains(words, phrase[-1]), F.filter(F.transform(words, start), lambda x: x.isNotNull()))
        return F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda x: F.struct(x.alias("at"), F.lit(label).alias("label")))

    return F.concat(*(places(phrase.split(" "), label) for phrase, label in phrases))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = numbered(docs, id_col, text_col)
    own = written(license_spans(rows, templates, **how).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best")), "license_spans")
    words = rows.select("row", "doc_id", word_array(F.col("text")).alias("w"))
    base = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), base_places(F.col("w")).alias("p"))
    base = written(base.select("row", "doc_id", "n_words", F.size("p").cast("long").alias("n_base"), F.array_min("p.at").cast("long").alias("first_word"), F.array_max("p.at").cast("long").alias("last_word"), F.array_sort(F.array_distinct("p.label")).alias("b")), "base_places")
    some, others = parted(base, own, "row")
    joined = some.join(own, "row", "left").unionByName(others, allowMissingColumns=True)
    labels = F.array_sort(F.array_union("b", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, MENTION).otherwise(0.0))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("b", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
