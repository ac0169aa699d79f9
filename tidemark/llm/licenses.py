"""License scan by canonical digest lookup.

Every line of a text is put in a canonical form: lower case, copyright lines removed, equivalent spellings made one,
punctuation and white space made single spaces. A unit is a run of whole lines (up to the whole text), its form the forms
of its lines joined; how a text is wrapped, and blank lines in it, change nothing. The SHA-256 digest of a unit's whole
form is hash-joined to the digests of known license texts and notices, put in the same form. There is no partial match: a
unit either is a known text or is not.

A unit can only be a known text if its first line starts with the first two words of one (a known text starts with a line
of two words at least), so only such lines are looked up, and a unit is as long as the known text. The known texts are a
fixed list of a few dozen, so their side of the join is broadcast; its size does not depend on the data. Only matches are
grouped by document.

Defined results: null and empty texts match nothing; rows without an identifier are one document, like rows that share
one, which gets one result with the matches of all its rows, for each of them; an empty table gives an empty table;
further columns are ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

# License texts and notices, as published.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_THIRD = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to
<https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely
in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE
SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""

KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY),
    ("ISC", "ISC License " + _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + "." + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 " + _BOOST),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0-or-later", _GPL.format(n=2)),
    ("GPL-3.0-or-later", _GPL.format(n=3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("proprietary", "All rights reserved."),
)
# Texts published whole, by the first two words, the length and the SHA-256 digest of their canonical form;
# where a text has an appendix on its use, also without it.
KNOWN_DIGESTS: tuple[tuple[str, str, int, str], ...] = (
    ("Apache-2.0", "apache license", 9886, "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "apache license", 8870, "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Artistic-1.0-Perl", "the artistic", 5833, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "creative commons", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free", 19578, "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "gnu free", 22013, "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "gnu general", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "gnu general", 9415, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "gnu general", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "gnu general", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "gnu general", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "gnu general", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "gnu library", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "gnu library", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "gnu lesser", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "gnu lesser", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "gnu lesser", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public", 22466, "b4fb601cd1d708fd4d48958cfaecb8bb919d60af95b4704afb85d1a886f8b303"),
    ("MPL-2.0", "mozilla public", 14341, "12274540925f246f7614a52b7ebddfbe0463ff1ab194088c554c73552c45582d"),
)
#: A line that names a holder and a year, or carries the sign: it differs in every copy of a license.
COPYRIGHT_LINE = r"^[^a-z0-9©]*(copyright[ \t]*(\(c\)|©|[0-9\[<])|(\(c\)|©)[ \t]*[0-9\[<])[^\n]*"
#: Equivalent spellings: pattern and the form kept; applied to lower-case text, in this order.
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"licenc", "licens"),
    (r"sub[ -]licens", "sublicens"),
    (r"non[ -]?infring", "noninfring"),
    (r"non[ -]commercial", "noncommercial"),
    (r"copyright owner", "copyright holder"),
    (r"acknowledgement", "acknowledgment"),
    (r"https://", "http://"),
)
#: ASCII punctuation, controls and white space, and the typographic marks that stand for them.
SEPARATORS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x{a0}\x{a9}\x{2010}-\x{201f}\x{2022}]+"


def canonical(line: Column) -> Column:
    """The canonical form of a line."""
    out = F.regexp_replace(F.lower(line), COPYRIGHT_LINE, "")
    for pattern, kept in SPELLINGS:
        out = F.regexp_replace(out, pattern, kept)
    return F.trim(F.regexp_replace(out, SEPARATORS, " "))


def forms(text: Column) -> Column:
    """The lines of a text that have a form: array of (line_no from 1, form)."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct((i + 1).alias("line_no"), canonical(line).alias("form")))
    return F.filter(lines, lambda line: line["form"] != "")


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda line: line["form"]), " ")


def known_digests(
    spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str, int, str], ...] = KNOWN_DIGESTS
) -> DataFrame:
    """(license, head, chars, digest) of all known texts: the first two words of the form, its length and its digest."""
    form = joined(forms(F.col("known_text")))
    rows = spark.createDataFrame(list(texts), "license string, known_text string").select("license", form.alias("form"))
    made = rows.select("license", F.substring_index("form", " ", 2).alias("head"), F.length("form").alias("chars"), F.sha2("form", 256).alias("digest"))
    return made.union(spark.createDataFrame(list(digests), "license string, head string, chars int, digest string")).distinct()


def matches(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, license, whole): a known text that starts at a line (from 1), and whether it is all of the text."""
    heads = [r[0] for r in known.select("head").distinct().collect()]  # a few dozen
    rows = docs.select(F.col(key).alias("id"), forms(text_or_empty(text)).alias("lines"))
    at = F.filter(
        F.transform("lines", lambda line, i: F.when(F.substring_index(line["form"], " ", 2).isin(heads), i + 1)),
        lambda i: i.isNotNull(),
    )
    starts = rows.withColumn("starts", at).filter(F.size("starts") > 0).select("id", "lines", F.explode("starts").alias("start"))
    first = F.element_at("lines", F.col("start"))
    found = starts.withColumn("line_no", first["line_no"]).join(F.broadcast(known), F.substring_index(first["form"], " ", 2) == F.col("head"))
    # Every line has a letter or digit at least, and a space before the next one.
    unit = F.slice("lines", F.col("start"), F.floor(F.col("chars") / 2).cast("int") + 1)
    # How far whole lines reach when they first reach the length of the known text.
    reach = F.aggregate(
        unit,
        F.lit(-1),
        lambda n, line: F.when(n >= F.col("chars"), n).otherwise(n + 1 + F.length(line["form"])),
    )
    same = (reach == F.col("chars")) & (F.sha2(F.substring(joined(unit), F.lit(1), F.col("chars")), 256) == F.col("digest"))
    whole = (F.col("start") == 1) & (F.length(joined(F.col("lines"))) == F.col("chars"))
    return found.filter(same).select(F.col("id").alias(key), "line_no", "license", whole.alias("whole"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the licenses found (sorted, joined by commas), the number of lines at which a known text
    starts, and whether the whole text is one."""
    found = (
        matches(docs, known, key, text)
        .groupBy(F.col(key).alias("of"))
        .agg(
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
            F.count_distinct("line_no").alias("n_license_lines"),
            F.bool_or("whole").alias("whole_text"),
        )
    )
    return (
        docs.select(F.col(key).alias("id"))
        .join(found, F.col("id").eqNullSafe(F.col("of")), "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("licenses", F.lit("")).alias("licenses"),
            F.coalesce("n_license_lines", F.lit(0).cast("long")).alias("n_license_lines"),
            F.coalesce("whole_text", F.lit(False)).alias("whole_text"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    for pattern, kept in SPELLINGS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(kept)}, 'g')"
    return f"trim(regexp_replace({out}, {_quoted(SEPARATORS)}, ' ', 'g'))"


def _sql_forms(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10)), lambda x: {_sql_canonical('x')})"


ORACLE = f"""
WITH texts AS (
    SELECT license, array_to_string(list_filter({_sql_forms("known_text")}, lambda x: x <> ''), ' ') AS form
    FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}) AS v(license, known_text)
), known AS (
    SELECT license, array_to_string(string_split(form, ' ')[1:2], ' ') AS head, length(form) AS chars, sha256(form) AS digest FROM texts
    UNION
    SELECT * FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)}, {n}, {_quoted(d)})" for a, b, n, d in KNOWN_DIGESTS)}) AS v(license, head, chars, digest)
), lines AS (
    SELECT doc_id, {_sql_forms("coalesce(text, '')")} AS all_forms FROM documents
), runs AS (
    SELECT doc_id, list_filter(all_forms, lambda x: x <> '') AS forms,
           list_filter(range(1, len(all_forms) + 1), lambda i: all_forms[i] <> '') AS numbers
    FROM lines
), starts AS (
    SELECT doc_id, forms, numbers, unnest(range(1, len(forms) + 1)) AS start FROM runs
), found AS (
    SELECT doc_id, numbers[start] AS line_no, license, start = 1 AND length(array_to_string(forms, ' ')) = chars AS whole
    FROM starts JOIN known ON array_to_string(string_split(forms[start], ' ')[1:2], ' ') = head
    WHERE sha256(left(array_to_string(forms[start:], ' '), CAST(chars AS BIGINT))) = digest
      AND list_contains(list_transform(range(start, len(forms) + 1), lambda j: length(array_to_string(forms[start:j], ' '))), chars)
), grouped AS (
    SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT line_no) AS n_license_lines,
           bool_or(whole) AS whole_text
    FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n_license_lines, 0) AS n_license_lines, coalesce(whole_text, false) AS whole_text
FROM documents AS d LEFT JOIN grouped AS g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
"""
