r"""License scan by canonical digest lookup (native DataFrame operations only).

A text is brought to a canonical form in which every copy of a licence is the
same string: A-Z lower-cased, copyright lines removed, equivalent spellings
unified, every run of characters other than a-z and 0-9 made one space. Its
SHA-256 is then joined with the digests of known licence texts. The unit is an
entire text: the document itself, and each of its lines as a text of its own
(licence notices are one-line texts).

Defined cases: a null text is an empty text; texts whose canonical form is empty
match nothing; null doc_ids match by their text but their lines are reported
together under null; rows repeating a doc_id are each reported, with the line
matches of all rows of that doc_id; an empty table gives none; other columns are
ignored. The catalogue is a parameter: any (license_id, text) table.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# fixed values: spellings that licence comparison treats as the same
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# fixed values: licence texts and notices, as published
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

CATALOGUE = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_START + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    # whole texts as published, in files named by their ids
    *((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))),
]

#: A line that is a copyright notice, behind comment marks or not: with a sign, year
#: or holder's bracket, or made of capitalised words, years and addresses (a wrapped
#: line of prose that begins "copyright notice" or an item "(c) You must" is text);
#: and the rights reserved with it.
_WORD = r"(?:[A-Z0-9][^ \t\n]*|and|of|the|by|for|&|-|<[^>\n]*>|\([^)\n]*\))"
COPYRIGHT = (
    r"^[ \t#*/;%!<>-]*(?:"
    r"(?i:(?:portions[ \t]+)?copyright[ \t:,]*(?:\(c\)|©|[0-9<\[])|\(c\)[ \t]*(?:copyright|©|[0-9<\[])|©|all rights reserved)[^\n]*"
    rf"|(?:[Pp]ortions[ \t]+)?(?:[Cc]opyright[ \t:,]+|\([Cc]\)[ \t]+){_WORD}(?:[ \t]+{_WORD})*[ \t]*$)"
)


def _lines(text: Column) -> Column:
    """The text's lines in canonical form, but for spellings of two words."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), "(?dm)" + COPYRIGHT, "")
    c = F.lower(F.regexp_replace(c, r"[^A-Za-z0-9\n]+", " "))  # ASCII by now
    # every word between two spaces of its own, so that neighbours both are found
    c = F.replace(F.concat(F.lit(" "), F.replace(c, F.lit("\n"), F.lit(" \n ")), F.lit(" ")), F.lit(" "), F.lit("  "))
    for found, put in EQUIVALENT:
        if " " not in found:
            c = F.replace(c, F.lit(f" {found} "), F.lit(f" {put} "))
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.replace(x, F.lit("  "), F.lit(" ")))), lambda x: x != "")


def _pairs(line: Column) -> Column:
    """Unifies the spellings of two words."""
    c = F.concat(F.lit(" "), F.replace(line, F.lit(" "), F.lit("  ")), F.lit(" "))
    for found, put in EQUIVALENT:
        if " " in found:
            c = F.replace(c, F.lit(f" {found.replace(' ', '  ')} "), F.lit(f" {put} "))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def digests(text: Column) -> Column:
    """whole: SHA-256 of the canonical whole text, null if that is empty; lines: of
    its canonical lines that aren't empty. The lines are made once for both."""

    def of(lines: Column) -> Column:
        whole = F.sha2(_pairs(F.array_join(lines, " ")), 256)
        return F.struct(F.nullif(whole, F.sha2(F.lit(""), 256)).alias("whole"), F.transform(lines, lambda x: F.unhex(F.sha2(_pairs(x), 256))).alias("lines"))

    return F.element_at(F.transform(F.array(_lines(text)), of), 1)


def catalogue(spark, texts=tuple(CATALOGUE)) -> DataFrame:
    """license_id and digest of the known licences, one row a digest."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in texts])
    known = spark.range(1).select(F.explode(rows).alias("r")).select("r.license_id", digests(F.col("r.text"))["whole"].alias("digest"))
    return known.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the whole text), n_license_lines and
    line_licenses (distinct, sorted, comma-joined) of every row."""
    known = catalogue(docs.sparkSession) if known is None else known
    d = docs.select("doc_id", digests(F.col("text").cast("string")).alias("both"))
    d = materialize(d.select("doc_id", F.col("both.whole").alias("digest"), F.col("both.lines").alias("lines")), "license-digests")
    at_line = known.select(F.unhex("digest").alias("line"), F.col("license_id").alias("id"))
    found = d.select("doc_id", F.explode("lines").alias("line")).join(at_line, "line").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))
    out = d.join(known, "digest", "left").join(found.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("ids", F.lit("")).alias("line_licenses"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    c = f"regexp_replace(coalesce({text}, ''), {_sql_text('(?m)' + COPYRIGHT)}, '', 'g')"
    c = f"lower(regexp_replace({c}, '[^A-Za-z0-9\\n]+', ' ', 'g'))"
    c = f"replace(' ' || replace({c}, chr(10), ' ' || chr(10) || ' ') || ' ', ' ', '  ')"
    for found, put in EQUIVALENT:
        if " " not in found:
            c = f"replace({c}, ' {found} ', ' {put} ')"
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(replace(x, '  ', ' '))), lambda x: x <> '')"


def _sql_pairs(line: str) -> str:
    c = f"' ' || replace({line}, ' ', '  ') || ' '"
    for found, put in EQUIVALENT:
        if " " in found:
            c = f"replace({c}, ' {found.replace(' ', '  ')} ', ' {put} ')"
    return f"trim(replace({c}, '  ', ' '))"


SQL = f"""
WITH v(license_id, text) AS (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in CATALOGUE)}),
known AS (SELECT sha256({_sql_pairs("array_to_string(l, ' ')")}) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql_lines("text")} AS l FROM v) GROUP BY 1),
d AS (SELECT doc_id, {_sql_lines("text")} AS l FROM documents),
w AS (SELECT doc_id, nullif(sha256({_sql_pairs("array_to_string(l, ' ')")}), sha256('')) AS digest FROM d),
f AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS ids
  FROM (SELECT doc_id, sha256({_sql_pairs("line")}) AS digest FROM (SELECT doc_id, unnest(l) AS line FROM d)) x JOIN known k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license_id, coalesce(f.n, 0)::BIGINT AS n_license_lines, coalesce(f.ids, '') AS line_licenses
FROM w LEFT JOIN known k USING (digest) LEFT JOIN f ON w.doc_id IS NOT DISTINCT FROM f.doc_id
"""
