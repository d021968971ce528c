"""License scans by canonical digest.

A text is brought to canonical form (lower case, copyright lines dropped,
equivalent spellings unified, everything but letters and digits collapsed to
single blanks), hashed with SHA-256, and hash-joined to the digests of known
licence texts. Each line has a canonical form of its own, of which that of the
text is put together, so every line is also looked up as a notice. The known
texts are a fixed list (the caller's, or ``known_texts``), so their digests have
a bound: licences as published, with and without title and appendix, notices and
SPDX lines.

Defined cases: null text counts as empty and, like a text without letters or
digits, matches nothing; very long texts are read whole; repeated rows are
reported each; a null id is reported like any other; a text known under two names
has the first in order; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Spellings that licence comparison treats as one.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("fulfilment", "fulfillment"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("©", "(c)"),
    ("https://", "http://"),
)

# Licence texts and notices as their authors published them.
KNOWN = (
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)

# Names that notices give the licences.
NAMES = (
    ("MIT", "the MIT License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-2.0", 'the Apache License, Version 2.0 (the "License")'),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("ISC", "the ISC License"),
    ("Zlib", "the zlib License"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("Unlicense", "the Unlicense"),
)
NOTICES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.")
FOLDER = Path(__file__).parent / "known_licenses"


@cache
def known_texts() -> tuple[tuple[str, str], ...]:
    """Name and text: KNOWN and the files of FOLDER, these with and without title and appendix, and notices of all names."""
    out = list(KNOWN)
    titled = [("MIT", dict(reversed(KNOWN))["MIT"]), *((p.stem, p.read_text()) for p in sorted(FOLDER.glob("*.txt")))]
    for name, text in titled:
        text = text.strip()
        bodies = [text]
        head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            bodies += [head, head + end]
        out += [(name, x) for body in bodies for x in (body, body.partition("\n\n")[2])]
    out += [(name, form.format(said)) for name, said in NAMES for form in NOTICES]
    for name in dict.fromkeys(name for name, _ in out):
        ends = ("", "-only", "-or-later") if "GPL" in name or name.startswith("GFDL") else ("",)
        out += [(name, f"SPDX-License-Identifier: {name}{end}") for end in ends]
    return tuple(out)


def _canonical_line(line: Column) -> Column:
    out = F.when(F.lower(line).rlike(r"^[ \t]*(?:copyright|\(c\)|©)"), "").otherwise(F.lower(line))
    for odd, usual in SPELLINGS:
        out = F.replace(out, F.lit(odd), F.lit(usual))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines that have one; joined by blanks they are that of the text."""
    return F.filter(F.transform(F.split(text, "\n"), _canonical_line), lambda x: x != "")


def canonical_digest(text: str) -> str:
    """The digest that ``scan`` gives a text, for the few known ones."""
    out = re.sub(r"(^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*", r"\1", text.lower())
    for odd, usual in SPELLINGS:
        out = out.replace(odd, usual)
    return hashlib.sha256(re.sub(r"[\W_]+", " ", out).strip().encode()).hexdigest()


def known_digests(known: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The first name in order of each digest."""
    return dict(sorted(((canonical_digest(text), name) for name, text in known), reverse=True))


def scan(docs: DataFrame, known: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, text_digest, text_license, line_licenses``: the licence that a text is as a whole, and those its lines name."""
    spark, named = docs.sparkSession, known_digests(known_texts() if known is None else known)
    table = F.broadcast(spark.createDataFrame(list(named.items()), "text_digest string, text_license string"))
    lines = {d: n for d, n in named.items() if d != canonical_digest("")}
    rows = docs.select("doc_id", canonical_lines(text_of()).alias("lines"))
    # the known digests are few: those among a text's lines are found within its row
    found = F.array_intersect(F.transform("lines", lambda x: F.sha2(x, 256)), F.array(*map(F.lit, lines)))
    names = F.create_map(*[F.lit(x) for pair in lines.items() for x in pair])
    rows = rows.select("doc_id", F.sha2(F.concat_ws(" ", "lines"), 256).alias("text_digest"), F.when(F.size("lines") > 0, found).alias("found"))
    licenses = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda d: F.element_at(names, d)))), ",")
    return rows.join(table, "text_digest", "left").select("doc_id", "text_digest", "text_license", F.coalesce(licenses, F.lit("")).alias("line_licenses"))


def _canonical_sql(c: str) -> str:
    out = rf"regexp_replace(lower({c}), '(^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*', '\1', 'g')"
    for odd, usual in SPELLINGS:
        out = f"replace({out}, '{odd}', '{usual}')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def license_sql() -> str:
    values = ", ".join(f"('{digest}', '{name}')" for digest, name in known_digests(known_texts()).items())
    return f"""
WITH known(digest, license) AS (VALUES {values}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
          FROM lines JOIN known ON sha256({_canonical_sql("line")}) = digest GROUP BY doc_id),
docs AS (SELECT doc_id, sha256({_canonical_sql("coalesce(text, '')")}) AS text_digest FROM documents)
SELECT d.doc_id, d.text_digest, k.license AS text_license, coalesce(n.line_licenses, '') AS line_licenses
FROM docs d LEFT JOIN known k ON d.text_digest = k.digest LEFT JOIN named n ON d.doc_id = n.doc_id
"""
