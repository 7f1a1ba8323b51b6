"""Licence scan by canonical digests; DataFrame functions only.

A text is made canonical: lower case, lines with a copyright notice left out, equivalent spellings made
one, anything but letters and digits a single space. The digest of the canonical text is joined to the
digests of known licences. Entire texts are looked up: the whole document, and each of its lines as a text
of its own, which is where notices stand in documents. Known texts are a DataFrame (licence, text).

How it scales: a unit can only match when its canonical length is that of a known text, so nearly all
lines end at a length test, before any digest or join. The known texts are a parameter of checked size: up
to KNOWN rows they are broadcast; beyond it the join is shuffled.

Defined results: null and empty texts match nothing, nor does a text of copyright lines only. Known texts
with equal canonical forms: the first licence name in alphabetical order. One row per unit that matches;
repeated documents and repeated lines each give rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm.cluster import written

KNOWN = 50_000
#: Equivalent spellings, each pair (pattern, one spelling); in this order.
SPELLINGS = (
    ("licence", "license"),
    ("https?://", ""),
    (r"\bversion\b", "v"),
    (r"\bv\.? ?([0-9])", "v $1"),
    ("&", " and "),
    ("non-?commercial", "non commercial"),
    ("merchantibility", "merchantability"),
)
#: Without any of these in its lower-case form, canonical() leaves a text's letters and digits alone.
MARKERS = ("licence", "://", "version", "&", "merchantibility", "copyright", "©", "(c)")
COPYRIGHT = r"(?m)^.*(?:\bcopyright\b\s*(?:\(c\)|©|[0-9])|\(c\)\s*[0-9]|©).*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = f"""{_BSD_2}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

{_AS_IS}"""
_BSD_2 = f"{_BSD_2}\n{_AS_IS}"
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MIT_0 = _MIT.replace(", subject to the following conditions:", ".").replace("""

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""", "")

#: Known texts to begin with: short licences, and the one-line notices by which longer ones are applied.
TEXTS = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "Licensed under the MIT License.", "Released under the MIT License.", "This work is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "ISC": [_ISC, "ISC License\n\n" + _ISC, "Licensed under the ISC License."],
    "0BSD": [_ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")],
    "Apache-2.0": [_APACHE, "Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": [_GPL.format(3), "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": [_GPL.format(2), "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "BSD-3-Clause": [_BSD_3, "BSD 3-Clause License\n\n" + _BSD_3, "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": [_BSD_2, "BSD 2-Clause License\n\n" + _BSD_2, "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB],
    "Unlicense": [_UNLICENSE],
    "BSL-1.0": [_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST],
    "MIT-0": [_MIT_0, "MIT No Attribution\n\n" + _MIT_0],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def known_texts(spark: SparkSession, path: str | None = None) -> DataFrame:
    """License and text of TEXTS and of the Parquet table at path, which may hold any number of entire texts."""
    own = spark.createDataFrame([(name, text) for name, texts in TEXTS.items() for text in texts], "license string, text string")
    return own if path is None else own.unionByName(spark.read.parquet(path).select("license", "text"))


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    for pattern, one in SPELLINGS:
        out = F.regexp_replace(out, pattern, one)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digests(known: DataFrame) -> DataFrame:
    """license, digest, canonical length and number of letters of the known texts, one row per digest."""
    rows = known.where("text is not null").select("license", canonical(F.col("text")).alias("c")).where("c <> ''")
    return rows.groupBy(F.sha2("c", 256).alias("digest"), F.char_length("c").alias("length"), letters(F.col("c")).alias("letters")).agg(F.min("license").alias("license"))


def letters(text: Column) -> Column:
    """Code points that are letters or digits."""
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, unit ('document' or 'line'), position (0, or the line from 0), license and digest."""
    table = written(digests(known), "licence-digests")
    sizes = table.agg(F.count("*").alias("n"), F.collect_set("letters").alias("letters"), F.collect_set("length").alias("lengths")).first() if known.count() <= KNOWN else None
    rows = docs.select(docs["doc_id"], docs["text"]).where("text is not null and text <> ''")
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "unit_text"))
    units = lines.select("doc_id", F.lit("line").alias("unit"), "position", "unit_text")
    whole = rows.where(F.contains("text", F.lit("\n"))).select("doc_id", F.lit("document").alias("unit"), F.lit(0).alias("position"), F.col("text").alias("unit_text"))
    units = units.unionByName(whole)
    if sizes is not None:  # exact: what can change the letters is let through
        low = F.lower("unit_text")
        changed = F.lit(False)
        for marker in MARKERS:
            changed = changed | F.contains(low, F.lit(marker))
        units = units.where(changed | letters(low).isin(sizes["letters"]))
    units = units.select("doc_id", "unit", "position", canonical(F.col("unit_text")).alias("c"))
    if sizes is not None:
        units = units.where(F.char_length("c").isin(sizes["lengths"]))
    near = F.broadcast(table) if sizes is not None else table
    found = units.where("c <> ''").select("doc_id", "unit", "position", F.sha2("c", 256).alias("digest")).join(near.select("digest", "license"), "digest")
    return found.select("doc_id", "unit", "position", "license", "digest")


def oracle() -> str:
    """The same rows from DuckDB."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in TEXTS.items() for text in texts)

    def form(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT)}, ' ', 'g')"
        for pattern, one in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(one.replace('$', chr(92)))}, 'g')"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    return f"""
WITH known AS (SELECT sha256({form("text")}) AS digest, min(license) AS license FROM (VALUES {values}) AS t(license, text) GROUP BY 1),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''),
u AS (SELECT doc_id, 'line' AS unit, CAST(generate_subscripts(lines, 1) - 1 AS INT) AS position, unnest(lines) AS unit_text FROM l
  UNION ALL SELECT doc_id, 'document', 0, text FROM l WHERE contains(text, chr(10))),
c AS (SELECT doc_id, unit, position, {form("unit_text")} AS c FROM u)
SELECT doc_id, unit, position, license, digest FROM (SELECT doc_id, unit, position, sha256(c) AS digest FROM c WHERE c <> '') JOIN known USING (digest)
"""
