"""Licence scan by canonical digest lookup.

A text is brought to a canonical form: lines of copyright statements go, and a short licence's title at the head; letters become lower-case, equivalent spellings
one spelling, and every run of characters that are neither letters nor digits one space. The SHA-256 of the form
is joined with the digests of the known licences; so a licence is found when the
entire text is that licence, however it is wrapped, punctuated or attributed. Single lines are looked up in
the same way among the known notices. The known licences are DIGESTS, of texts too long to be kept here, and LICENCES, which go through the same
expression as the texts; a table of further digests can be given. A licence in none of them is not found.

Edge cases: a null text, or one that is empty in canonical form, has a null digest and no licence; texts of any length;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import bound
from .staging import pick

#: Spellings that licence matching treats as equal, the second for the first.
SPELLINGS = {
    "acknowledgment": "acknowledgement",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "copyright owner": "copyright holder",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "https": "http",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "non infringement": "noninfringement",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub licence": "sublicense",
    "sub license": "sublicense",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, '
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Texts of known licences, without titles and copyright lines.
LICENCES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS '
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _NO_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _NO_WARRANTY,
    "BSD-2-Clause": _BSD_TWO + _BSD_END,
    "BSD-3-Clause": _BSD_TWO
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    + _BSD_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
    "not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and "
    "to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS '
    "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
    "For more information, please refer to <https://unlicense.org/>"
)
LICENCES["Unlicense"] = _UNLICENSE
LICENCES["BSL-1.0"] = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n"
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
    "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE '
    "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE."
)
#: Digests of the canonical forms of public licence texts, as their stewards publish them; those with an appendix also without it.
DIGESTS = {
    "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543": "Apache-2.0",
    "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40": "Apache-2.0",
    "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}
#: One-line notices.
NOTICES = {
    "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    "Released under the MIT License": "MIT",
    "Licensed under the MIT License": "MIT",
    "This work is licensed under the GNU General Public License, version 3": "GPL-3.0",
    "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "This file is in the public domain": "public-domain",
}
#: Statements only: a wrapped line may well begin with the words `copyright notice` or with a list's `(c)`. Patterns here read alike in Java and RE2.
COPYRIGHT_LINE = r"^[ \t*#/;%!-]*(?:copyright[ \t]*(?:\(c\)|©|:|[0-9]{4}|<|\[|by\b)|\(c\)[ \t]*(?:copyright\b|[0-9]{4})|©|all rights reserved)[^\n]*$"
#: Titles of the short licences, alone on the first line that is not a copyright statement, with more text below.
TITLE = (
    r"(?i)\A[ \t\r\n*#/;%!=-]*(?:the[ \t]+)?(?:(?:mit|expat|isc|0bsd|zlib|zlib/libpng|bsd)|(?:bsd[ \t-]*)?(?:zero|0|2|two|3|three)[ \t-]*clause(?:[ \t-]*bsd)?)(?:[ \t]+licen[sc]e)?"
    r"(?:[ \t]*\((?:the[ \t]+)?(?:mit|expat|isc|0bsd|zlib|bsd[a-z0-9 \t-]*)(?:[ \t]+licen[sc]e)?\))?[ \t.:*#/=-]*\r?\n"
)
LETTER = r"[\p{L}\p{N}]"
#: Every canonical notice has one of these words, so a line without them needs no digest.
TELLING = r"(?i)licen[sc]e|public[^\p{L}\p{N}]+domain"


def _wide(words: str) -> str:
    """Words as they stand in a form with two spaces between words, so that neighbours share none."""
    return f" {words.replace(' ', '  ')} "


def _any_spelling() -> str:
    """A pattern for any spelling, by first letters, so that most words are passed over at their first."""
    by_letter: dict[str, list[str]] = {}
    for old in SPELLINGS:
        by_letter.setdefault(old[0], []).append(old[1:].replace(" ", "  "))
    return " (?:" + "|".join(f"{c}(?:{'|'.join(ends)})" for c, ends in by_letter.items()) + ") "


def canonical(text: Column) -> Column:
    """The canonical form; null where nothing is left."""

    def untitled(body: Column) -> Column:
        return F.when(body.rlike(TITLE), bound(F.regexp_replace(body, TITLE, ""), lambda rest: F.when(rest.rlike(LETTER), rest).otherwise(body))).otherwise(body)

    def spelt(wide: Column) -> Column:
        out = wide
        for old, new in SPELLINGS.items():
            out = F.replace(out, F.lit(_wide(old)), F.lit(f" {new} "))
        return F.when(wide.rlike(_any_spelling()), out).otherwise(wide)

    def form(body: Column) -> Column:
        return F.concat(F.lit(" "), F.regexp_replace(F.lower(untitled(body)), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))

    wide = bound(F.regexp_replace(text, "(?dim)" + COPYRIGHT_LINE, ""), form)
    out = F.replace(bound(wide, spelt), F.lit("  "), F.lit(" "))
    return F.nullif(F.trim(out), F.lit(""))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def _canonical_sql(text: str) -> str:
    """The same form as an expression of standard SQL."""
    text_of = lambda x: "'" + x.replace("'", "''") + "'"
    body = f"regexp_replace({text}, {text_of('(?im)' + COPYRIGHT_LINE)}, '', 'g')"
    untitled = f"regexp_replace({body}, {text_of(TITLE)}, '')"
    out = f"' ' || regexp_replace(lower(CASE WHEN regexp_matches({untitled}, {text_of(LETTER)}) THEN {untitled} ELSE {body} END), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for old, new in SPELLINGS.items():
        out = f"replace({out}, {text_of(_wide(old))}, {text_of(f' {new} ')})"
    return f"nullif(trim(regexp_replace({out}, ' +', ' ', 'g')), '')"


def _oracle() -> str:
    rows = lambda table: ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in table)
    return f"""WITH given(license_id, body) AS (VALUES {rows(LICENCES.items())}),
known AS (SELECT DISTINCT sha256({_canonical_sql("body")}) AS digest, license_id FROM given UNION SELECT * FROM (VALUES {rows(DIGESTS.items())})),
said(body, name) AS (VALUES {rows(NOTICES.items())}), notice AS (SELECT sha256({_canonical_sql("body")}) AS digest, name FROM said),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM documents),
hits AS (SELECT l.doc_id, n.name FROM (SELECT doc_id, sha256({_canonical_sql("body")}) AS digest FROM lines WHERE regexp_matches(body, '{TELLING}')) l JOIN notice n USING (digest)),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM hits GROUP BY doc_id),
own AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT own.doc_id, own.digest, known.license_id, coalesce(found.n, 0) AS n_notice_lines, coalesce(found.names, '') AS notices FROM own LEFT JOIN known USING (digest) LEFT JOIN found ON found.doc_id = own.doc_id"""


def known_digests(spark) -> DataFrame:
    """(digest, license_id) of the entire texts."""
    rows = spark.createDataFrame(list(LICENCES.items()), "license_id string, text string")
    held = spark.createDataFrame(list(DIGESTS.items()), "digest string, license_id string")
    return rows.select(digest(F.col("text")).alias("digest"), "license_id").distinct().union(held)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """Per row: the id, digest, license_id (of the entire text, or null), n_notice_lines and notices (names found in single lines, sorted).
    ``more``: further known licences (digest, license_id), whose digests are of canonical forms; of two names the first in order stays."""
    source = pick(docs, doc_id=id_col, text=text_col)
    spark = docs.sparkSession
    notices = spark.createDataFrame(list(NOTICES.items()), "text string, license_id string").select(digest(F.col("text")).alias("digest"), "license_id")
    table = F.create_map(*[F.lit(x) for r in notices.collect() for x in (r.digest, r.license_id)])
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(TELLING))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(table, digest(x))), lambda x: x.isNotNull())
    rows = source.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    known = known_digests(spark)
    if more is None:
        known = F.broadcast(known)
    else:  # of any size
        known = known.union(more.select("digest", "license_id")).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return rows.join(known, "digest", "left").select(
        F.col("doc_id").alias(id_col), "digest", "license_id", F.size("found").cast("long").alias("n_notice_lines"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices")
    )


ORACLE = _oracle()
