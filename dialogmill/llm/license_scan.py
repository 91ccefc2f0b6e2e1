"""License scans by canonical digest lookup.

A text is brought to a canonical form: case, copyright lines, punctuation, white space and equivalent spellings
don't matter. Its SHA-256 is joined with the digests of known licence texts and notices, whole text against whole
text. A document is looked up as a whole, and each of its lines as a text of its own, which finds licence notices
inside documents. Every line is looked up, whatever words it has.

Known texts come as a list or a table (license_id, text), and digests of canonical texts as a list of pairs; the ones
built in are the entire texts of MIT, ISC, 0BSD, BSD-2-Clause, BSD-3-Clause, Zlib and Unlicense, the digests of the
entire texts of Apache-2.0, GPL-2.0, GPL-3.0, LGPL-2.1, LGPL-3.0, MPL-2.0, Artistic-1.0 and CC0-1.0, and short notices. The join is Spark's to plan.

Rows: a null or empty text, and a line without a word, match nothing. Repeated rows, rows that share an id and rows
with null id are each looked up by their own text. Very long texts only make more lines. An empty table, or no known
texts, gives no matches. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm.common import table

# Equivalent spellings, each with the one that stands for both.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("noncommercial", "non commercial"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("whilst", "while"),
    ("http", "https"), ("per cent", "percent"), ("ver", "version"), ("v", "version"),
]
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_HOLDERS = _BSD_END.format("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS")
_BSD_2 = _BSD_HEAD + _HOLDERS
_BSD_3 = _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _HOLDERS
_BSD_3_REGENTS = _BSD_HEAD + "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END.format("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""
# Licence identifiers with texts and notices known for them.
KNOWN = [
    ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", _MIT),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("ISC", "ISC License\n" + _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END), ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_2), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_2), ("BSD-3-Clause", _BSD_3), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_3), ("BSD-3-Clause", _BSD_3_REGENTS),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB), ("Unlicense", _UNLICENSE),
    ("0BSD", "BSD Zero Clause License\n" + _GRANT + ".\n" + _ISC_END), ("0BSD", _GRANT + ".\n" + _ISC_END),
]


#: Digests of the canonical forms of entire licence texts that are too long to hold here.
KNOWN_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "5ba11b2822dc524ea2386d767b0b72c7f8d5cdc53637e3a3f51aeb4426be0583"),
    ("GPL-2.0", "5b2676459651a3af2c342c0bdf3567f7445c35933aa790ea06ba921ef174a7c0"),
    ("GPL-3.0", "42f0c43940f098f58138c12a2d653afe564f291fa3d7b56eaee2ab33b6099e40"),
    ("LGPL-2.1", "ad1c1812f6afd45d1be54c9c4f4428c0ebea04f040dfee7d55301c3c5fa94e1a"),
    ("LGPL-3.0", "297070d60ea6411d4a894602e68d90071b22d5d24b039421e865ee2caeaa5077"),
    ("MPL-2.0", "1349706f86c49d0a570db0a527a2a2b14b17be452c5c70a071bead01baccc88b"),
    ("Artistic-1.0", "64c3cef3f40196e89f99445eb68154c242eff24c735587cd11fb57436f3b05b8"),
    ("CC0-1.0", "0c3e4ca5ed7ced6289d3f5d9a83e4100f9f34d87983b17dc5865376a8a0a98f3"),
]


def with_canonical(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with out: copyright lines off, lower case, letters and digits only, single spaces, one spelling.

    Step by step, so that what few texts need is done for these only, behind a plain search for a word.
    """
    lines = r"(?m)^[ \t]*(?:©|\(c\)[ \t]|copyright[ \t]+(?:\(c\)|©|[0-9])|all rights reserved)[^\n]*$"
    c = F.col(out)
    df = df.withColumn(out, F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn(out, F.when(c.contains("copyright") | c.contains("©") | c.contains("(c)") | c.contains("all rights reserved"), F.regexp_replace(c, lines, " ")).otherwise(c))
    plain = F.length(c) == F.octet_length(c)
    df = df.withColumn(out, F.trim(F.when(plain, F.regexp_replace(c, r"[^a-z0-9]+", " ")).otherwise(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))))
    one = c
    for other, same in SPELLINGS:
        one = F.regexp_replace(one, f"(?<![^ ]){other}(?![^ ])", same)
    df = df.withColumn(out, F.when(c.rlike("(?:^| )(?:" + "|".join(o for o, _ in SPELLINGS) + ")(?: |$)"), one).otherwise(c))
    return df.withColumn(out, F.when(c.contains("version "), F.regexp_replace(c, r"version (?=[0-9])", "")).otherwise(c))


def with_digest(df: DataFrame, text_col: str, out: str = "digest", empty: bool = True) -> DataFrame:
    """df with the digest of the canonical text; rows without a word only with empty."""
    found = with_canonical(df, text_col, "canonical__")
    found = found if empty else found.where("canonical__ <> ''")
    return found.withColumn(out, F.sha2(F.encode("canonical__", "UTF-8"), 256)).drop("canonical__")


def known_digests(spark: SparkSession, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """license_id and digest; the smallest id where two texts have one canonical form. known: pairs, or a table."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license_id string, text string")
    texts = with_canonical(rows.select("license_id", "text"), "text", "canonical__").where("canonical__ <> ''")
    found = texts.select("license_id", F.sha2(F.encode("canonical__", "UTF-8"), 256).alias("digest"))
    found = found.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return found.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def licensed(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, license_id (of the whole text, or null), n_license_lines, line_licenses (ascending, by commas) for each row."""
    rows = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text__"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row__"))
    whole = with_digest(rows, "text__").drop("text__").join(known, "digest", "left")
    lines = rows.select("id__", "row__", F.posexplode(F.split("text__", "\n")).alias("at__", "line__"))
    hits = with_digest(lines, "line__", empty=False).select("id__", "row__", "at__", "digest").join(known, "digest")
    # rows are named by id and text: repeated rows don't add up
    by_row = hits.groupBy("id__", "row__").agg(F.countDistinct("at__").alias("n__"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("l__"))
    joined = whole.join(by_row, whole["id__"].eqNullSafe(by_row["id__"]) & (whole["row__"] == by_row["row__"]), "left").select(whole["id__"], "digest", "license_id", "n__", "l__")
    return joined.select(F.col("id__").alias(id_col), "digest", "license_id", F.coalesce("n__", F.lit(0)).cast("bigint").alias("n_license_lines"), F.coalesce("l__", F.lit("")).alias("line_licenses"))


def op6_license_scan(spark, sf_dir):
    # the texts built in are a list of this module, so their digests may be broadcast
    return licensed(table(spark, sf_dir, "documents").select("doc_id", "text"), F.broadcast(known_digests(spark)))


def _sql_canonical(x: str) -> str:
    out = rf"regexp_replace(coalesce({x}, ''), '(?im)^[ \t]*(?:©|\(c\)[ \t]|copyright[ \t]+(?:\(c\)|©|[0-9])|all rights reserved)[^\n]*$', ' ', 'g')"
    out = rf"' ' || trim(regexp_replace(lower({out}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    out = f"replace({out}, ' ', '  ')"
    for other, one in SPELLINGS:
        out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
    return f"regexp_replace(trim(replace({out}, '  ', ' ')), 'version ([0-9])', '\\1', 'g')"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP6_SQL = (
    "WITH k0(license_id, text) AS (VALUES " + ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN) + "), "
    "k1(license_id, digest) AS (VALUES " + ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN_DIGESTS) + "), "
    f"k AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({_sql_canonical('text')}) AS digest FROM k0 UNION ALL SELECT license_id, digest FROM k1) GROUP BY digest), "
    "r AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents), "
    f"d AS (SELECT k, doc_id, sha256({_sql_canonical('text')}) AS digest FROM r), "
    "l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM r), "
    f"h AS (SELECT l.k, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS found FROM l JOIN k ON k.digest = sha256({_sql_canonical('line')}) GROUP BY l.k) "
    "SELECT d.doc_id, d.digest, k.license_id, coalesce(h.n, 0)::BIGINT AS n_license_lines, coalesce(h.found, '') AS line_licenses "
    "FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN h ON d.k = h.k"
)
