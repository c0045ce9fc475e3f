"""License scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (case, punctuation, white space, lines
that only state a copyright, spellings that mean the same) and its digest is
looked up among the digests of known licenses by a hash join. This is done for
entire texts and, for notices, for each entire line that may match. The known
side is a fixed list of a few rows, which bounds the broadcast.

Defined cases: a null or empty text has the digest of the empty string and no
license; a document without a license is still one row; repeated rows give
repeated rows; an empty table gives an empty result; extra columns of the input
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import ascii_lower, text_of

# Known license texts and notices, public wording.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN: list[tuple[str, str]] = [
    ("Unlicense", UNLICENSE),
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", "\n".join([BSD_CONDITIONS, BSD_DISCLAIMER])),
    ("BSD-3-Clause", "\n".join([BSD_CONDITIONS, BSD_THIRD, BSD_DISCLAIMER])),
    ("BSD-2-Clause", "\n".join(["BSD 2-Clause License", BSD_CONDITIONS, BSD_DISCLAIMER])),
    ("BSD-3-Clause", "\n".join(["BSD 3-Clause License", BSD_CONDITIONS, BSD_THIRD, BSD_DISCLAIMER])),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
]
#: Canonical digests of entire public license texts too long to state here; of some also without their appendix.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "a4f874aaeee4dfe824fb3cc3dcca2009"),
    ("Apache-2.0", "5d2795cb35f13d3f170c4a82e7d9f97f"),
    ("Artistic-1.0-Perl", "a8b0fb0c6e43a3b36bdc159e59dbfd1e"),
    ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23"),
    ("GFDL-1.2", "c969fdb4b731dadf7173c1ffbe49a117"),
    ("GFDL-1.3", "eb6b86c0fad89753a5a36c484fa0ada2"),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-1.0", "dbf3c47f5a8f127e58d08cabc1ebb916"),
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c"),
    ("GPL-2.0", "68380dbeadb093b94ecf563db7312db7"),
    ("GPL-3.0", "5eaa767cc0a56c87c3852144458a3bf1"),
    ("GPL-3.0", "444f95dc767ede978b60cfb20fbd0bca"),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.0", "c396ba2f94537628797123bc12cd2d6e"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "252dfbcf46f9012c7c356a9252f1c30c"),
    ("MPL-2.0", "b5b7a0cf4994910cd0204fba4637d6ec"),
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),
]
#: Letters of which each known text has some in a row; a line without them needs no digest.
NEEDED = ("licen", "software", "redistribution")
#: Spellings that mean the same, as whole words after case and punctuation are gone.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
]
#: A line that only states a copyright: the word or sign comes first.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(copyright (©|\(c\)|[0-9])|©|\(c\) ?[0-9]|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words with single spaces, one spelling."""
    c = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, " ")
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, NOT_WORD, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(c)


def _may_match(text: Column) -> Column:
    """Whether a text has the letters that every known text has; cheap, and true more often than need be."""
    low = F.lower(text)
    may = F.lit(False)
    for letters in NEEDED:
        may = may | F.contains(low, F.lit(letters))
    return may


def known_digests(spark: SparkSession) -> DataFrame:
    """digest and license of the fixed list; a few rows."""
    known = spark.createDataFrame(KNOWN, "license string, known string").select("license", F.md5(canonical(F.col("known"))).alias("digest"))
    return known.union(spark.createDataFrame(DIGESTS, "license string, digest string")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: digest of the whole text, its license or null, and its lines' notices.

    ``notices`` holds the sorted licenses of the lines, comma-joined, and
    ``n_notices`` counts those lines.
    """
    known = F.broadcast(known_digests(docs.sparkSession))
    whole = text_of(docs, text)
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(whole).alias("key"), whole.alias("text"))
    whole_digests = keyed.select("doc_id", "key", F.md5(canonical(F.col("text"))).alias("digest"))
    lines = keyed.filter(_may_match(F.col("text"))).select("key", F.explode_outer(F.split("text", "\n")).alias("line"), "doc_id").filter(_may_match(F.col("line")))
    hits = lines.select("doc_id", "key", F.md5(canonical(F.col("line"))).alias("digest")).join(known, "digest")
    by_doc = hits.groupBy("doc_id", "key").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"), F.count(F.lit(1)).alias("lines"))
    # Repeated rows were counted together; each gets its own share.
    copies = whole_digests.groupBy("doc_id", "key", "digest").agg(F.count(F.lit(1)).alias("copies"))
    found = copies.join(known, "digest", "left")
    on = found["doc_id"].eqNullSafe(by_doc["doc_id"]) & (found["key"] == by_doc["key"])
    joined = found.join(by_doc, on, "left").select(
        found["doc_id"],
        "digest",
        "license",
        F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce((F.col("lines") / F.col("copies")).cast("long"), F.lit(0)).alias("n_notices"),
        "copies",
    )
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
