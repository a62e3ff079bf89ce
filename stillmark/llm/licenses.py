"""Licence scans: canonical digests of entire texts, hash-joined to the digests of known licences. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

# The wording of well-known public licences and notices, and spellings that count as equal.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_TEXTS = {
    "MIT": _MIT,
    "Unlicense": _UNLICENSE,
    "BSL-1.0": _BOOST,
    "ISC": _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_DISCLAIMER,
    "0BSD": _ISC_GRANT + ".\n" + _ISC_DISCLAIMER,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": _ZLIB,
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}
# The names that licences are published under, as headings before their text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib"],
}
KNOWN_LICENSES = _TEXTS | {f"{name} (titled: {title})": f"{title}\n\n{_TEXTS[name]}" for name, titles in TITLES.items() for title in titles}
# Digests of the canonical form of long licences as published, the copies that systems ship.
KNOWN_DIGESTS = {
    "Apache-2.0": "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0": "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    "GPL-2.0": "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}
EQUAL_SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "acknowledgement": "acknowledgment",
    "noncommercial": "non commercial",
    "sublicence": "sublicense",
    "favour": "favor",
    "authorised": "authorized",
    "organisation": "organization",
    "whilst": "while",
    "fulfil": "fulfill",
    "https": "http",
}
#: A notice names a sign, a year or a holder after a colon; a licence's own words may begin a line with "copyright" or "(c)".
#: Lines end at line feeds only, here and in SQL.
NOTICE = (
    r"^[\x20\t]*(?:(?:\(c\)[\x20\t]*)?copyright\b[\x20\t,]*(?:\(c\)|\u00a9|:|[0-9]{4}\b)|\(c\)[\x20\t]*[0-9]{4}\b|\u00a9)[^\n]*$"
    r"|^[\x20\t]*all rights reserved[\x20\t\r.]*$"
)
COPYRIGHT_LINE = "(?md)" + NOTICE
BETWEEN_WORDS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\u00a0\u2000-\u206f]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright notices, words apart by single spaces, one spelling; null stays null.

    A notice goes to the end of its line; apart from that, where lines are wrapped makes no difference. While spellings are
    exchanged each word has two spaces of its own, so words that follow one another all are.
    """
    col = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, " ")
    col = F.concat(F.lit(" "), F.trim(F.regexp_replace(col, BETWEEN_WORDS, "  ")), F.lit(" "))
    for spelling, same in EQUAL_SPELLINGS.items():
        col = F.replace(col, F.lit(f" {spelling} "), F.lit(f" {same} "))
    return F.trim(F.replace(col, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, licenses: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """license_id and digest of each known text, by the same rules as the documents; a table has license_id, license_text.

    Without ``licenses`` the texts here and the digests of long ones are meant.
    """
    known = licenses if isinstance(licenses, DataFrame) else spark.createDataFrame(list((licenses or KNOWN_LICENSES).items()), "license_id string, license_text string")
    if licenses is None:
        fixed = spark.createDataFrame([(d, i) for i, d in KNOWN_DIGESTS.items()], "license_digest string, license_id string")
        texts = known.select(digest(F.col("license_text")).alias("license_digest"), "license_id")
        return texts.unionByName(fixed).groupBy("license_digest").agg(F.min("license_id").alias("license_id"))
    return known.groupBy(digest(F.col("license_text")).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id, is_license for every document: does its entire text equal a known licence's?

    A licence under a heading with its published name is known as such (``BSD-3-Clause (titled: ...)``), and so are a few
    one-line notices (``... (notice)``), which aren't whole licences.

    Every whole text is normalised and hashed in one pass; the join is on the digest. The known side is a table of fixed
    size by default; a large one is joined by shuffle like any other, as no hint is given.

    Defined results: null text has null digest and no licence; empty text has the digest of the empty string, which is no
    licence; very long texts are hashed whole; repeated rows each give a row; equal digests among the known ones count for
    the smallest license_id; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text").cast("string")).alias("digest"))
    joined = rows.join(known, rows.digest == known.license_digest, "left")
    return joined.select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def oracle_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def signs(pattern: str) -> str:
        return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)

    def canonical_sql(text: str) -> str:
        lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        sql = f"' ' || trim(regexp_replace(regexp_replace({lowered}, '(?m){signs(NOTICE)}', ' ', 'g'), '{signs(BETWEEN_WORDS)}', '  ', 'g')) || ' '"
        for spelling, same in EQUAL_SPELLINGS.items():
            sql = f"replace({sql}, ' {spelling} ', ' {same} ')"
        return f"sha256(trim(replace({sql}, '  ', ' ')))"

    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in KNOWN_LICENSES.items())
    fixed = ", ".join(f"({quoted(d)}, {quoted(k)})" for k, d in KNOWN_DIGESTS.items())
    return f"""
WITH known AS (
  SELECT d, min(i) AS license_id FROM (SELECT {canonical_sql("t")} AS d, i FROM (VALUES {known}) AS v(i, t) UNION ALL SELECT * FROM (VALUES {fixed}) AS f(d, i)) GROUP BY 1),
docs AS (SELECT doc_id, {canonical_sql("text")} AS digest FROM documents)
SELECT doc_id, digest, license_id, license_id IS NOT NULL AS is_license FROM docs LEFT JOIN known ON digest = d
"""
