"""License scans by canonical digests (native).

A text is brought to a canonical form - A-Z lower-cased, copyright lines dropped, punctuation and white space to single spaces,
equivalent spellings unified - and hashed. Looked up are the whole text and, wherever the opening words of a known text stand, as many words as
that has: so a license or a notice is found inside a document too, however its lines are broken. All these digests are hash-joined to those of the known texts
in one join. Only DataFrame functions run.

Defined results: null text counts as empty; an empty text has the digest of the empty string and no license; repeated rows
stay repeated; extra columns of the input are not read; an empty table gives no rows. Non-ASCII letters stay as they are."""

from __future__ import annotations

import hashlib
import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only states a copyright: the word or sign, then a sign, a year, a placeholder or "by". The same in Java and RE2.
COPYRIGHT_LINE = r"(^|\n)[^\na-z0-9]*(copyright[ \t:]*(\(c\)|©|[0-9]{4}|<|\[|by )|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
GAPS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Equivalent spellings, as whole words between single spaces; applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("labour", "labor"), ("whilst", "while"), ("organisation", "organization"), ("recognised", "recognized"), ("cancelled", "canceled"), ("judgement", "judgment"),
    ("noninfringement", "non infringement"), ("noncommercial", "non commercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"), ("v3", "version 3"), ("v2", "version 2"),
)

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Known license texts and notices, (id, text); the files of license_texts, whole texts of longer licenses, come to these. Callers may pass others.
KNOWN = (
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
)
#: Words of a known text by which its places are found.
OPENING = 3


def known_texts() -> list[tuple[str, str]]:
    """KNOWN, and the whole texts beside this module."""
    return [*KNOWN, *sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt"))]


def canonical(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, "\n"), GAPS, " ")
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def canonical_form(text: str) -> str:
    """The same of a text at hand: the known texts, a fixed list, need no job."""
    t = text.translate(str.maketrans(UPPER, LOWER))
    t = " " + re.sub(GAPS, " ", re.sub(COPYRIGHT_LINE, "\n", t)).strip(" ") + " "
    for a, b in SPELLINGS:
        t = t.replace(f" {a} ", f" {b} ")
    return t.strip(" ")


def _spans(form: Column, known: list[tuple[str, str]]) -> Column:
    """Digests of the spans of a canonical text that begin like a known text and have as many words."""
    n = min([OPENING, *(len(k.split(" ")) for _, k in known)])
    sizes: dict[str, set[int]] = {}
    for _, k in known:
        sizes.setdefault(" ".join(k.split(" ")[:n]), set()).add(k.count(" ") + 1)
    by = F.create_map(*[x for o, c in sorted(sizes.items()) for x in (F.lit(o), F.array(*map(F.lit, sorted(c))))])
    some = F.lit(False)
    for o in sorted(sizes):
        some = some | form.contains(o)
    nothing = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        at = F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), F.try_element_at(by, F.array_join(F.slice(w, i, n), " ")).alias("sizes"))), lambda x: x["sizes"].isNotNull())
        spans = F.flatten(F.transform(at, lambda x: F.transform(F.filter(x["sizes"], lambda c: x["i"] + c - 1 <= F.size(w)), lambda c: F.sha2(F.array_join(F.slice(w, x["i"], c), " "), 256))))
        return F.array_distinct(spans)

    return F.when(some, F.flatten(F.transform(F.array(F.split(form, " ")), of))).otherwise(nothing)


def license_scan(docs: DataFrame, known=None) -> DataFrame:
    """doc_id, digest, n_canonical (characters), license_id (of the whole text, null if unknown), notices (sorted ids of the known texts that
    the text holds; empty if none). known: (id, text) pairs, known_texts() if not given: a list whose size the code fixes, hence broadcast."""
    spark = docs.sparkSession
    forms = [(i, canonical_form(t)) for i, t in (known_texts() if known is None else known)]
    forms = [(i, t) for i, t in forms if t]
    ids: dict[str, str] = {}
    for i, t in sorted(forms, reverse=True):
        ids[hashlib.sha256(t.encode()).hexdigest()] = i  # of one text under several names the first
    pairs = F.array(*[F.struct(F.lit(d).alias("looked"), F.lit(i).alias("known_id")) for d, i in sorted(ids.items())])
    by = spark.range(1).select(F.explode(pairs).alias("k")).select("k.*") if ids else spark.createDataFrame([], "looked string, known_id string")

    def rows(form: Column) -> Column:
        own = F.sha2(form, 256)
        row = lambda looked, whole: F.struct(own.alias("digest"), F.length(form).cast("long").alias("n_canonical"), looked.alias("looked"), F.lit(whole).alias("whole"))
        return F.concat(F.array(row(own, True)), F.transform(_spans(form, forms), lambda d: row(d, False))) if forms else F.array(row(own, True))

    # the canonical form is a variable of the function, so it is made once for all that is asked of it
    asked = docs.select("doc_id", F.explode(F.flatten(F.transform(F.array(canonical(F.col("text"))), rows))).alias("x")).select("doc_id", "x.*")
    found = asked.join(F.broadcast(by), "looked", "left")
    # rows of one id and digest have equal results: they are counted, and given out as often
    one = found.groupBy("doc_id", "digest", "n_canonical").agg(
        F.sum(F.col("whole").cast("int")).alias("copies"), F.min(F.when(F.col("whole"), F.col("known_id"))).alias("license_id"), F.collect_set(F.when(~F.col("whole"), F.col("known_id"))).alias("ids")
    )
    out = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "digest", "n_canonical", "license_id", F.array_join(F.array_sort("ids"), ",").alias("notices"))


def _sql_canonical(x: str) -> str:
    t = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
    t = f"regexp_replace(regexp_replace({t}, '{COPYRIGHT_LINE}', chr(10), 'g'), '{GAPS}', ' ', 'g')"
    t = f"' ' || trim({t}) || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"trim({t})"


def license_sql(known=None) -> str:
    """The same rows in DuckDB SQL, which looks for the canonical texts themselves instead of their digests."""
    rows = ", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in (known_texts() if known is None else known))
    return f"""with known as (select license_id, {_sql_canonical('known_text')} as own from (values {rows}) k(license_id, known_text)),
form as (select row_number() over () as r, doc_id, {_sql_canonical('text')} as form from documents),
found as (select r, string_agg(distinct license_id, ',' order by license_id) as notices, min(license_id) filter (own = form) as license_id
  from form join known on own <> '' and contains(' ' || form || ' ', ' ' || own || ' ') group by r)
select doc_id, sha256(form) as digest, cast(length(form) as bigint) as n_canonical, license_id, coalesce(notices, '') as notices from form left join found using (r)"""
