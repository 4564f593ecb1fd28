"""Licence scans: canonical texts are looked up by digest among known licences and notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import small, written

# Texts of licences and common notices, by SPDX identifier.
_WARRANTY_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_WARRANTY_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_WARRANTY_BSD = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
LICENCES = (
    ("MIT", "MIT License\nCopyright (c) <year> <holders>\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY_MIT),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY_ISC),
    ("BSD-2-Clause", _BSD + _WARRANTY_BSD),
    ("BSD-3-Clause", _BSD + _BSD_3 + _WARRANTY_BSD),
    ("Zlib", "zlib License\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
# SPDX identifiers, each of which is also known by its line "SPDX-License-Identifier: ...".
IDENTIFIERS = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense WTFPL Zlib".split()
LICENCES += tuple((i, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS)
# SHA-256 of the canonical text of licences that are too long to be written out here.
DIGESTS = (
    ("Apache-2.0", "f269048df0419dd6e48ae0775a3e4b6f0590341338b983d6904ba3b7117c42a5"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3-only", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "5fc5b48e8eeed6e5e77c32ad8641a6bc04d25011d6b500aa7dc7f3183ab812ea"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
)
# Spellings that mean the same in a licence.
EQUIVALENT = tuple(x.split(" ") for x in (
    "acknowledgement acknowledgment|analogue analog|analyse analyze|artefact artifact|authorisation authorization|authorised authorized|calibre caliber|cancelled canceled|capitalisation capitalization|catalogue catalog|categorise categorize|centre center|emphasised emphasized|favour favor|favourite favorite|fulfil fulfill|fulfilment fulfillment|initialise initialize|judgement judgment|labelling labeling|labour labor|licence license|licenced licensed|maximise maximize|modelled modeled|modelling modeling|offence offense|optimise optimize|organisation organization|organise organize|practise practice|programme program|realise realize|recognise recognize|signalling signaling|utilisation utilization|whilst while|wilful willful"
).split("|")) + (("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"))

#: Lines that name who holds the copyright, and nothing else.
_HOLDER = r"(?i)(?:^|(?<=[\n\r]))[\x20\x09*#/]*(?:copyright\b(?![\x20\x09]+(?:holder|owner|notice|law))|\(c\)|©|all rights reserved)[^\n\r]*+"


_HOLDER_WORDS = ("copyright", "(c)", "©", "all rights reserved")


def _any(c: Column, words) -> Column:
    """Whether a text has one of the words: a plain search, which spares most texts the patterns."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def _one_spelling(c: Column) -> Column:
    for other, one in EQUIVALENT:
        c = F.regexp_replace(c, rf"\b{other}(?=s?\b)", one)
    return c


def units(df: DataFrame, text: str, keep: list[str], lines: bool = True) -> DataFrame:
    """Kept columns, place, unit: a row with place 0 and the canonical text, then one for each of its lines that isn't empty.

    Canonical: without lines that say who holds the copyright, without case, punctuation and spacing, in one spelling.
    A null text has a null unit. Each step is behind a generator, so that it is done once and not in each of its uses.
    """
    step = lambda d, e, name: d.select(*keep, F.explode(F.array(e)).alias(name))
    low = step(df, F.lower(text), "_l")
    open_ = F.when(_any(F.col("_l"), _HOLDER_WORDS), F.regexp_replace("_l", _HOLDER, " ")).otherwise(F.col("_l"))
    plain = step(low, F.regexp_replace(open_, r"[^\p{L}\p{M}\p{N}\n\r]++", " "), "_p")
    parts = F.array(F.trim(F.regexp_replace("_p", r"[ \n\r]++", " ")))
    if lines:
        parts = F.concat(parts, F.coalesce(F.split("_p", r"[\n\r]++"), F.array().cast("array<string>")))
    each = plain.select(*keep, F.posexplode(parts).alias("place", "_u")).select(*keep, "place", F.trim("_u").alias("_u"))
    spelled = F.when(_any(F.col("_u"), [o for o, _ in EQUIVALENT]), _one_spelling(F.col("_u"))).otherwise(F.col("_u"))
    return each.where("place = 0 or _u <> ''").select(*keep, "place", spelled.alias("unit"))


def digest(unit: Column) -> Column:
    """SHA-256 of a canonical text; null for null and for nothing."""
    return F.when(F.length(unit) > 0, F.sha2(unit, 256))


def known_digests(spark: SparkSession, texts: tuple[tuple[str, str], ...] = LICENCES, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(digest, license) of known texts and digests, one row for each digest."""
    rows = spark.createDataFrame(list(texts), "license string, t string")
    given = spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license")
    return units(rows, "t", ["license"], lines=False).select(digest(F.col("unit")).alias("digest"), "license").where("digest is not null").unionByName(given).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license, notices of every row.

    digest and license are those of the entire text (license: null if unknown); notices: the licences whose notice is
    an entire line of the text, sorted and joined by commas, '' for none. Null and empty texts have a null digest. Rows
    are kept apart even if their ids repeat or are null. `known`: (digest, license), distinct digests.
    """
    known = small(written(known_digests(docs.sparkSession) if known is None else known, "known"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")
    looked = units(rows, "text", ["doc_id", "rid"]).withColumn("digest", digest(F.col("unit"))).join(known, "digest", "left")
    found = written(looked.where("place = 0 or license is not null").select("doc_id", "rid", "place", "digest", "license"), "units")  # what is written keeps its rid
    notices = found.where("place > 0").groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return found.where("place = 0").join(notices, "rid", "left").select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
