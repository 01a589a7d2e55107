"""License scans by canonical digests.

A text is brought into a canonical form: lower case, no copyright lines, equivalent spellings as one, punctuation and
white space as single spaces.  The SHA-256 of that form is looked up among the digests of known licences, which went
through the same form.  The table of known licences is a parameter; a small one is broadcast, a large one joined.

Whole texts are looked up, and apart from them each of their lines, which finds notices and licences on one line inside
other text.  Every text is brought into its form once, with line breaks kept; the digests of the whole and of its lines go
through one join, whose few rows are written, and hits of lines return by the digest of their own text.

Defined results: null texts, and texts of which nothing is left in canonical form, have a null digest and no licence;
texts and lines of any length are looked up whole; known texts with one digest count as one licence with all their names;
a licence stays with its row, whatever ids are repeated or null, and repeated rows have the same ones; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Texts of licences and notices as published, without their copyright lines.
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_NO_LIABILITY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", f"{_CONDITIONS}\n{_NO_LIABILITY}"),
    ("BSD-3-Clause", f"{_CONDITIONS}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_NO_LIABILITY}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_TAIL}"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("X11", None),
    ("MIT-0", None),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
    ("PostgreSQL", """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.
IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS."""),
    ("Apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
)

_MIT = dict(KNOWN)["MIT"]
_DERIVED = {
    "X11": f"{_MIT}\nExcept as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the copyright holders.",
    "MIT-0": _MIT.replace(", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "."),
}
KNOWN = tuple((name, body or _DERIVED[name]) for name, body in KNOWN)


def known_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text): the texts above, the longer ones of the folder licence_texts as published, and their tags."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    texts = [*KNOWN, *((f.stem, f.read_text(encoding="utf-8")) for f in files)]
    tags = [(f"{name}-tag", f"SPDX-License-Identifier: {name}") for name, _ in texts if not re.search("notice|header|-UC", name)]
    return (*texts, *tags)


#: Applied in this order to lower-case text with its line breaks, each to words of its own.
WORDS = (
    (r"(?m)^[^a-z0-9(©\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$", " "),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r"licenc", "licens"),
    (r"\b(fav|hon|col|behavi|lab)our", r"\1or"),
    (r"\b(organ|author|recogn|util|initial|real|custom|normal|general|final|minim|maxim|optim|summar)is(e|es|ed|ing|ation|ations)\b", r"\1iz\2"),
    (r"acknowledgement", "acknowledgment"),
)
#: Applied in this order to a whole text or one line, to runs of words.
RUNS = (
    (r"[ \n]+", " "),
    (r" ?\ball rights reserved\b", ""),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bsub licens", "sublicens"),
    (r"\bper cent\b", "percent"),
)
#: Known licences that are broadcast, about 100 bytes each; larger tables are joined without a hint.
MOST_BROADCAST = 20_000


def _replaced(form: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        form = F.regexp_replace(form, pattern, to.replace("\\1", "$1").replace("\\2", "$2"))
    return form


def words(text: Column) -> Column:
    return _replaced(F.lower(text), WORDS)


def canonical(words_: Column) -> Column:
    return F.trim(_replaced(words_, RUNS))


def digest(words_: Column) -> Column:
    form = canonical(words_)
    return F.when(F.length(form) > 0, F.sha2(form, 256))


def known_digests(spark: SparkSession, known: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    rows = spark.createDataFrame(list(known_texts() if known is None else known), "license string, body string")
    return rows.select("license", digest(words(F.col("body"))).alias("digest"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license (of the whole text or null), line_licenses (sorted, of single lines)."""
    known = known.where("digest is not null").groupBy("digest").agg(F.array_join(F.sort_array(F.collect_set("license")), "|").alias("license"))
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    texts = docs.select("doc_id", F.sha2("text", 256).alias("key"), words(F.col("text")).alias("words"))
    lines = F.array_distinct(F.transform(F.filter(F.split("words", "\n"), lambda x: F.length(x) > 1), lambda x: F.sha2(canonical(x), 256)))
    marked = lambda x, whole: F.struct(F.lit(whole).alias("whole"), x.alias("digest"))
    every = F.concat(F.array(marked(digest(F.col("words")), True)), F.coalesce(F.transform(lines, lambda x: marked(x, False)), F.array().cast("array<struct<whole:boolean,digest:string>>")))
    met = texts.select("doc_id", "key", F.explode(every).alias("x")).select("doc_id", "key", "x.whole", "x.digest").join(known, "digest", "left")
    met = materialize(met.where(F.col("whole") | F.col("license").isNotNull()))
    hits = met.where("not whole").groupBy("key").agg(F.sort_array(F.collect_set("license")).alias("line_licenses"))
    none = F.array().cast("array<string>")
    return met.where("whole").join(hits, "key", "left").select("doc_id", "digest", "license", F.coalesce("line_licenses", none).alias("line_licenses"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(spark))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def _sql_replaced(form: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in rules:
        form = f"regexp_replace({form}, '{pattern}', '{to}', 'g')"
    return form


def _sql_canonical(column: str) -> str:
    return f"trim({_sql_replaced(column, RUNS)})"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1_SQL = f"""
WITH bodies AS (
    SELECT license, {_sql_replaced("lower(body)", WORDS)} AS words FROM (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in known_texts())}) AS t(license, body)
), known AS (
    SELECT digest, string_agg(DISTINCT license, '|' ORDER BY license) AS license FROM (SELECT license, sha256({_sql_canonical("words")}) AS digest FROM bodies) GROUP BY digest
), texts AS (
    SELECT doc_id, {_sql_replaced("lower(text)", WORDS)} AS words FROM documents
), forms AS (
    SELECT doc_id, {_sql_canonical("words")} AS form FROM texts
), lines AS (
    SELECT doc_id, unnest(string_split(words, chr(10))) AS line FROM texts
), found AS (
    SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
    FROM (SELECT doc_id, sha256({_sql_canonical("line")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id
)
SELECT f.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, k.license, coalesce(line_licenses, '') AS line_licenses
FROM forms f LEFT JOIN known k ON form <> '' AND sha256(form) = k.digest LEFT JOIN found ON found.doc_id = f.doc_id
"""
