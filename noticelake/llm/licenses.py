"""Licence scan by canonical digests: DataFrame functions only.

A text is made canonical line by line: lower case, equivalent spellings unified, punctuation and
runs of blanks reduced to single spaces, copyright lines dropped. The canonical lines joined by
spaces are the canonical text. Its SHA-256 is hash-joined to the digests of known licences, whole
text to whole text; the same canonical form of each single line is looked up among the digests of
known one-line notices, so that a licence stated inside a longer document is found too.

Known are the licences of `TEXTS`, given in full, and those of `DIGESTS`, whose texts are long: there
the digest of the canonical text stands alone.

Defined cases: a null text counts as empty; a text without words has no licence; texts of any length
are read whole; equal rows each get a result; where known texts of several identifiers have one
canonical form, the first identifier in order is given for a whole text and all of them for a notice; a
line that begins like a copyright line but speaks of a licence is kept; an empty table gives an empty
result; other columns are carried whatever their names, but those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import Shield

RESULTS = ["text_digest", "license_id", "n_notices", "notice_ids"]

#: Equivalent spellings (pattern, replacement), applied in this order to lower-case text.
SPELLINGS = [
    (r"licence", "license"),
    (r"sub-?licens", "sublicens"),
    (r"non-commercial", "noncommercial"),
    (r"merchantibility", "merchantability"),
    (r"\b(version |v\.? ?)([0-9])", "$2"),
    (r"\bgnu general public license\b", "gnu gpl"),
    (r"creative commons attribution", "cc by"),
    (r"https?://", ""),
    (r"&", " and "),
]
LINE_BREAK = r"\r\n|\n|\r"
#: Fixed patterns: a line that states a copyright, and what it must not hold as well.
COPYRIGHT_LINE, BUT = r"^\W*(copyright\b|©|\(c\)|all rights reserved)", r"licen[cs]e"

_MIT = """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Whole licence texts (identifier, text); a licence may have several customary forms.
TEXTS = [
    ("MIT", _MIT),
    ("MIT", _MIT.removeprefix("MIT License\n")),
    ("MIT", "The " + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "For more information, please refer to <https://unlicense.org/>"),
    ("Unlicense", _UNLICENSE + "For more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", _BOOST),
]
#: SHA-256 of the canonical form of whole licence texts (identifier, digest).
DIGESTS = [
    ("Apache-2.0", "0bb2c94b13709fa3badfb2731e8bdf97dc1ad7596211dbb88152c1a15897514c"),
    ("Apache-2.0", "71b63e66e6cdc58d66f92bd290290b7ea6113f85d402668f05ac0981c83a5e2c"),
    ("Apache-2.0", "b4c380f102a7232eca525c5b67c130151d1254e24ca36510dcc7239a74e2db02"),
    ("Apache-2.0", "d406b9dca1bb777d5514cb7be970bd2ca2722a4012833e1c92468f9046c52e52"),
    ("Artistic-1.0-Perl", "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915"),
    ("CC-BY-SA-4.0", "316c9b85113f0da16dc97420f9539e03e5876b3b29520764e89a7cd5615ac39d"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "7b074e457ef0b11306dec1bcf36f4ac56eebd0b9f82d7f4a9966c3bc04f9c215"),
    ("GFDL-1.3", "5bfc499a5f31dd5f90359dde5ac90fc02a48b26d8134de6818ddfe52c85503cd"),
    ("GPL-1.0", "a67757f1e2089c64e293ce491ebb983c17a3511ddffe5a2efb7a18af75fef8de"),
    ("GPL-2.0", "1f94b4058d12b9876f8c0d108a8d51e684c847d2f698083fcfbdc3213b3576fc"),
    ("GPL-2.0", "26e028fa946ecc516f17e45cf31a1e9468f946bc11fc8f6e7bd1573063c2062e"),
    ("GPL-2.0", "3247f3dce158058b61d49e4df9ac78f5ae6f14bd13df0fdde60596ce89438dcb"),
    ("GPL-2.0", "461f9d33bdb69a6a7bc8231b91122975b70b5558d19eafbab46cdc88524b93f1"),
    ("GPL-3.0", "2ca41f63b0c2a42369c4331080ac1e28755aec5e1aaa7ef39dbd7d32cb5ac342"),
    ("GPL-3.0", "3cf97c7ec28e141095a62ce8f1b3a5d67e14e19dd45651b8538761f7b5fd1762"),
    ("GPL-3.0", "6397fb46f33510edf537ff4d7e1a29a0d2b16dca5661683476a28e7b5e0e216d"),
    ("GPL-3.0", "d68936232844bfc08cb0cbb8739e2beb1ef56035678cf191675cd4c8ffa4e09a"),
    ("LGPL-2.0", "74f898e1d636591369e18c95d8a7dba69d056c74a8245c4feb1f50267b754dbb"),
    ("LGPL-2.0", "faa7d57fd020d689336e10f9b83b2c8fc95b2d788ae885ac8d91eb0dcf8e8e90"),
    ("LGPL-2.1", "29d0fbf6321f205444c4ac912f7ab14335973d3ccec82a59c0e545f1a79bde9c"),
    ("LGPL-2.1", "abf553ff7aa06b6be33fd6773eeca10251dddb65fc03a4cda1ad0ec44186953b"),
    ("LGPL-3.0", "297070d60ea6411d4a894602e68d90071b22d5d24b039421e865ee2caeaa5077"),
    ("MPL-1.1", "e6553678818331ca9684fab59856044718733864a8bb1ef79795afee85d157bc"),
    ("MPL-2.0", "5178a054001b0b950ae70a1d905a8af9b9a9df7f9e6c3e8310bdac9a5ca86f17"),
    ("NCSA", "bb6c44416437f5ab412ca9d762d4bdae1dc4e6a9c5afc9ac0965eb5e57b4e055"),
    ("OFL-1.1", "fbe659eae28091df95de005129bd83b4f2d193497bd82b12054590eb4685e866"),
    ("Unicode-3.0", "709193255cb8fb784e604deba2bc28a3961d1294a6a8b4cd632fbda6602e169a"),
]
#: One-line notices (identifier, line).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU GPL, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
]


def canonical_line(line: Column) -> Column:
    """A line in canonical form; null where it only states a copyright or has no words."""
    low = F.lower(line)
    form = low
    for pattern, plain in SPELLINGS:
        form = F.regexp_replace(form, pattern, plain)
    form = F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " "))
    return F.when((~low.rlike(COPYRIGHT_LINE) | low.rlike(BUT)) & (form != ""), form)


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), canonical_line), lambda x: x.isNotNull())


def text_digest(lines: Column) -> Column:
    """The digest of a text from its canonical lines; null for a text without words."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """(license_id, digest) of the given texts, made canonical by the same expressions, and of the given digests."""
    known = spark.createDataFrame(texts, "license_id string, text string").select("license_id", text_digest(canonical_lines(F.col("text"))).alias("digest"))
    return known.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string")).where("digest is not null").distinct()


def scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS, notices: list[tuple[str, str]] = NOTICES, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """docs with text_digest, license_id (of the whole text), n_notices and notice_ids (of single lines, sorted, comma-joined)."""
    spark, shield = docs.sparkSession, Shield(docs)
    lines = shield.frame.withColumn("lines", canonical_lines(shield["text"].cast("string"))).withColumn("text_digest", text_digest(F.col("lines")))
    whole = known_digests(spark, texts, digests).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    # the digests of known texts are constants of the caller: a few dozen short rows
    found = lines.join(F.broadcast(whole.withColumnRenamed("digest", "text_digest")), "text_digest", "left")
    stated = known_digests(spark, notices).groupBy("digest").agg(F.array_sort(F.collect_set("license_id")).alias("ids")).collect()  # one row a notice
    if stated:
        by_digest = F.create_map(*[x for r in stated for x in (F.lit(r["digest"]), F.array(*[F.lit(i) for i in r["ids"]]))])
        hits = F.filter(F.transform("lines", lambda x: F.element_at(by_digest, F.sha2(x, 256))), lambda x: x.isNotNull())
    else:
        hits = F.array().cast("array<array<string>>")
    marked = found.withColumn("hits", hits)
    return marked.select(
        *shield.restored(RESULTS), "text_digest", "license_id", F.size("hits").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten("hits"))), ",").alias("notice_ids"),
    )
