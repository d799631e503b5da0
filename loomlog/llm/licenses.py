"""Operator 10: licence scans by canonical digests. Native: DataFrame functions only.

A text is brought to a canonical form (copyright lines left out; case, punctuation and white space normalised; equivalent
spellings unified), and its SHA-256 is joined with the digests of known licence texts. Looked up are the whole text of a
document and each of its lines, for notices stand on lines of their own.

The known texts are notices made from names and phrases by rule, and the short licences in full: MIT, ISC, Zlib, BSD with two
and three clauses, Boost, the Unlicense and the notice of Apache-2.0. Of the long ones (GPL and its kin, MPL, EPL, Apache-2.0, Creative
Commons) only notices are known by default; their texts come as a table: any with the columns of ``known_texts`` may be given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence identifiers and the names that notices use for them.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0 License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
PHRASES = ["{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "Distributed under the {}", "Available under the {}", "This project is licensed under the {}"]
TEXTS = {
    "LicenseRef-all-rights-reserved": ["All rights reserved."],
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    ],
    "BSD-3-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    ],
    "BSL-1.0": [
        """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
    ],
}

#: Known digests (64 bytes each) up to which they are compared within each row and broadcast.
MOST_INLINE = 50_000
#: Rewriting steps of the canonical form, in order: pattern and replacement. They mean the same to Java and to RE2.
STEPS = [
    (r"(?im)^[^0-9A-Za-z\n©]*(copyright|\(c\)|©)([^0-9A-Za-z\n][^\n]*)?$", ""),  # copyright lines
    (r"(?i)licence", "license"),
    (r"(?i)acknowledgement", "acknowledgment"),
    (r"(?i)sub-licen", "sublicen"),
    (r"(?i)https://", "http://"),
    (r"(?i)\b(version|ver\.|v\.|v)[ \t]*([0-9])", r"v<2>"),
    (r"([0-9])\.0\b", "<1>"),
]
_LAST = [(r"[^\p{L}\p{N}\n]+", " "), (r" ?\n ?", "\n")]


def canonical(text: Column) -> Column:
    """The canonical form of a text, lines kept apart; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new.replace("<", "$").replace(">", ""))
    out = F.lower(out)
    for pattern, new in _LAST:
        out = F.regexp_replace(out, pattern, new)
    return out


def whole(canonical_text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_text, r"[ \n]+", " "))


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all that is looked up by default."""
    made = [(key, phrase.format(name)) for key, names in NAMES.items() for name in names for phrase in PHRASES]
    made += [(key, f"SPDX-License-Identifier: {key}") for key in NAMES]
    return made + [(key, text) for key, texts in TEXTS.items() for text in texts]


def digests(known: DataFrame) -> DataFrame:
    """digest and license of known texts, one row per digest; the empty text is none."""
    text = whole(canonical(F.col("text")))
    return known.where(F.col("license").isNotNull()).select(text.alias("t"), "license").where("t != ''").groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are left out), repeated ones too: doc_id, licenses (sorted, distinct), n_notices (lines that are a known text) and text_license (of the text as a whole, or null).

    ``known``: license and text, by default ``known_texts``. Up to MOST_INLINE digests are also compared within each
    row, so that only lines that will find their text are exploded, and the table is broadcast for the join; a larger
    one is joined by a shuffle. Null and empty texts have no licence.
    """
    spark = docs.sparkSession
    known = digests(spark.createDataFrame(known_texts(), "license string, text string") if known is None else known)
    few = [r[0] for r in known.select("digest").limit(MOST_INLINE + 1).collect()]
    small = len(few) <= MOST_INLINE
    parts = F.transform(F.array(canonical(F.col("text"))), lambda c: F.concat(F.array(whole(c)), F.transform(F.split(c, "\n"), lambda x: F.trim(x))))[0]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.transform(parts, lambda x, i: F.struct(i.alias("at"), F.sha2(x, 256).alias("digest"))).alias("parts"))
    if small:
        rows = rows.withColumn("parts", F.filter("parts", lambda x: x["digest"].isin(few)) if few else F.slice("parts", 1, 0))
    # a row without candidates has a key of its own, so that these rows don't meet in one partition
    rows = rows.select("row", "doc_id", F.explode_outer("parts").alias("x")).select("row", "doc_id", F.col("x.at").alias("at"), F.coalesce("x.digest", F.col("row").cast("string")).alias("digest"))
    joined = rows.join(F.broadcast(known) if small else known, "digest", "left")
    found = joined.groupBy("row", "doc_id").agg(F.count(F.when((F.col("at") > 0) & F.col("license").isNotNull(), 1)).alias("n_notices"), F.max(F.when(F.col("at") == 0, F.col("license"))).alias("text_license"), F.array_sort(F.collect_set("license")).alias("licenses"))
    return found.select("doc_id", "licenses", "n_notices", "text_license")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document; the list as one comma-joined string."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_notices", "text_license")


def _sql_canonical(text: str) -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    out = f"coalesce({text}, '')"
    for pattern, new in STEPS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new.replace('<', chr(92)).replace('>', ''))}, 'g')"
    out = f"lower({out})"
    for pattern, new in _LAST:
        out = f"regexp_replace({out}, {quoted(pattern)}, {'chr(10)' if new == chr(10) else quoted(new)}, 'g')"
    return out


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rows = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known_texts())
    tidy = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH k AS (SELECT min(license) AS license, t FROM (SELECT license, {tidy.format(_sql_canonical("text"))} AS t FROM (VALUES {rows}) AS v(license, text)) x WHERE t <> '' GROUP BY t),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_sql_canonical("text")} AS c FROM documents),
p AS (SELECT rid, 1 AS line, trim(unnest(string_split(c, chr(10)))) AS part FROM d UNION ALL SELECT rid, 0, {tidy.format("c")} FROM d),
f AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) FILTER (WHERE line = 1) AS n_notices, max(license) FILTER (WHERE line = 0) AS text_license FROM p JOIN k ON part = t GROUP BY rid)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_notices, 0) AS n_notices, text_license FROM d LEFT JOIN f ON d.rid = f.rid"""


QUERIES = {"op10_licenses": op10_licenses}
ORACLE_SQL = {"op10_licenses": _sql()}
