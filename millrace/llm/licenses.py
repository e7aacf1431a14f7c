"""License scans by canonical digest lookup.

A whole text is brought to a canonical form: lines that state a copyright dropped, ASCII lower case,
every run of anything but letters and digits one space, equivalent spellings and phrases made one. Two
texts that differ in layout, punctuation, holder or spelling alone have the same form, so a license is
recognised by one hash join of the form's SHA-256 with the digests of known licenses.

A line states a copyright if it begins, after any marks, with "(C)" or "\u00a9", with "(c)" and a year, or
with "copyright" and has a sign, a year, a placeholder for one or "all rights reserved" after it; running
text that a wrap begins with "copyright notice" or "(c) You must" stays. Short known texts go through the
same expressions, so they need no digests of their own; of long ones :data:`DIGESTS` holds the digest of
the form. The table of both is as large as the list of licenses given, and joined by hash like any other.

Defined results: a null text is empty; a text without a letter or digit outside copyright lines has the
digest of the empty form and no license; ids may be null or repeat, each row is looked up by itself; if
two known texts have the same form the first identifier by code point counts; a very long text is
brought to its form whole, in its own row; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIGN = r"(?:[(][cC][)]|\x{a9}|&copy;)"
_YEAR = r"(?:(?:19|20)[0-9][0-9]|[\[<{](?:yyyy|YYYY|year|YEAR|Year)[\]>}]|yyyy|YYYY)"
_COPYRIGHT = "[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]"
_RESERVED = "[Aa][Ll][Ll] [Rr][Ii][Gg][Hh][Tt][Ss] [Rr][Ee][Ss][Ee][Rr][Vv][Ee][Dd]"
#: Lines that state a copyright, or that all rights are reserved; the sign stands alone only in capitals.
COPYRIGHT = rf"(^|\n)[^A-Za-z0-9\n]*(?:{_COPYRIGHT}[^A-Za-z0-9\n][^\n]*?(?:{_SIGN}|{_YEAR}|{_RESERVED})|[(]C[)]|\x{{a9}}|[(]c[)][ \t]*(?:{_COPYRIGHT}|{_YEAR})|{_RESERVED})[^\n]*"

# Equivalent spellings, each word with the one it stands for.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed",
    "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful",
}
# Equivalent phrases, in the spellings that the words above stand for.
PHRASES = {
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "sub license": "sublicense", "sub licenses": "sublicenses", "sub licensed": "sublicensed",
    "sub licensing": "sublicensing", "sub licensee": "sublicensee", "sub licensees": "sublicensees", "non infringement": "noninfringement", "non commercial": "noncommercial",
    "per cent": "percent", "web site": "website", "merchant ability": "merchantability", "re distribution": "redistribution", "re distributions": "redistributions",
}

# The public texts of short licenses, and one-line notices, by their identifiers.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN = {
    "MIT": 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>',
    "Apache-2.0 (notice)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "MIT (line)": "Released under the MIT License.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
}


# Digests of the canonical forms of public license texts.
DIGESTS = {
    "Apache-2.0": "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    lower = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, ""), _UPPER, _LOWER)
    plain = F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    words = F.transform(F.split(plain, " "), lambda w: F.when(w.isin(*SPELLINGS), F.element_at(table, w)).otherwise(w))  # a set is asked before the map
    out = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))  # a word has its own space on either side, so phrases never overlap
    for phrase, same in PHRASES.items():
        out = F.replace(out, F.lit(f" {phrase.replace(' ', '  ')} "), F.lit(f" {same.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_licenses(spark: SparkSession, texts: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """``digest, license_id`` of known texts: a dict, or a table of ``license_id`` and ``text``; by default :data:`KNOWN` and :data:`DIGESTS`."""
    digests = {} if texts is not None else DIGESTS
    if not isinstance(texts, DataFrame):
        texts = spark.createDataFrame(list((KNOWN if texts is None else texts).items()), "license_id string, text string")
    form = texts.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''").select(F.sha2("form", 256).alias("digest"), "license_id")
    form = form.unionByName(spark.createDataFrame([(d, i) for i, d in digests.items()], "digest string, license_id string"))
    return form.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``digest`` and ``license_id`` (null if unknown) for each row."""
    digests = docs.select(F.col(id).alias("id"), F.sha2(canonical(F.col(text)), 256).alias("digest"))
    found = known.select(F.col("digest").alias("known"), "license_id")
    return digests.join(found, digests.digest == found.known, "left").select(F.col("id").alias(id), "digest", "license_id")


def report(docs: DataFrame) -> DataFrame:
    return scan(docs, known_licenses(docs.sparkSession))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in SPELLINGS.items()) + "}"
    lower = f"translate(regexp_replace(coalesce(text, ''), {quote(COPYRIGHT)}, '', 'g'), '{_UPPER}', '{_LOWER}')"
    form = f"' ' || array_to_string(list_transform(string_split(trim(regexp_replace({lower}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: coalesce({table}[w], w)), '  ') || ' '"
    for phrase, same in PHRASES.items():
        form = f"replace({form}, ' {phrase.replace(' ', '  ')} ', ' {same.replace(' ', '  ')} ')"
    form = f"trim(replace({form}, '  ', ' '))"
    known = " UNION ALL ".join(f"SELECT {quote(k)} AS license_id, {quote(v)} AS text" for k, v in KNOWN.items())
    given = ", ".join(f"({quote(d)}, {quote(i)})" for i, d in DIGESTS.items())
    return f"""WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256({form}) AS digest, license_id FROM ({known}) UNION ALL SELECT * FROM (VALUES {given}) v(digest, license_id)) u GROUP BY 1),
d AS (SELECT doc_id, sha256({form}) AS digest FROM documents)
SELECT doc_id, d.digest, license_id FROM d LEFT JOIN known ON d.digest = known.digest"""
