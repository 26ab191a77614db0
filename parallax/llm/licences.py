"""Licence scans by canonical digest, in DataFrame functions only.

A text is brought to a canonical form: copyright lines go, letters become lower case, punctuation becomes blanks, equivalent
spellings become one, blanks shrink. The digest of an entire text is hash-joined to digests of known licences and notices, which
went through the same expressions. Of texts that speak of licences, each paragraph and each line is such a unit too, so that a notice
within other text is found. The widest unit found names the licence: the text, else a paragraph, else a line.

Defined cases: a null text is empty; an empty text (or one of copyright lines only) has the digest of the empty text
and no licence; texts of any length are treated whole; repeated rows are looked up alike; if two known licences
had one canonical form, or several units of one kind are found, the first by name is named; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of public licences and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
LICENCES = (
    ("0BSD", _0BSD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
)
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GPL = """This program is free software{either} you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, {version}."""
_GNU = (("GPL", "General"), ("LGPL", "Lesser General"), ("AGPL", "Affero General"))
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_NAMED = (("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("ISC", "ISC License"), ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("Unlicense", "Unlicense"), ("Zlib", "zlib License"))
_OPENINGS = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.")


def _notices() -> list[tuple[str, str]]:
    """(license_id, text) of notices, most of them by rule."""
    out = [("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE.partition("\n")[0]), ("MPL-2.0", _MPL)]
    named = list(_NAMED)
    for short, name in _GNU:
        for v in ("2.0", "2.1", "3.0"):
            whole = v.removesuffix(".0")
            named += [(f"{short}-{v}", f"GNU {name} Public License, version {whole}"), (f"{short}-{v}", f"GNU {name} Public License v{v}"), (f"{short}-{v}-or-later", f"GNU {name} Public License, version {whole} or later")]
            out.append((f"{short}-{v}-or-later", _GPL.format(either=":", name=name, version=f"either version {whole} of the License, or (at your option) any later version")))
            out.append((f"{short}-{v}", _GPL.format(either=":", name=name, version=f"version {whole} of the License")))
    for short, name in _CC:
        for v in ("2.0", "3.0", "4.0"):
            scope = "International" if v == "4.0" else "Unported"
            named += [(f"CC-{short}-{v}", f"Creative Commons {name} {v} {scope} License")]
            out += [(f"CC-{short}-{v}", f"{verb} under CC {short} {v}.") for verb in ("Licensed", "Released", "This work is licensed")]
    return out + [(i, o.format(n)) for i, n in named for o in _OPENINGS]


NOTICES = tuple(_notices())
#: Equivalent spellings of words.
SPELLINGS = (("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("https", "http"), ("judgement", "judgment"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("noncommercially", "noncommercial"), ("organisation", "organization"), ("organisations", "organizations"), ("owner", "holder"), ("owners", "holders"), ("programme", "program"), ("whilst", "while"))
COPYRIGHT_LINE = r"(^|\n)[ \t]*([Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt] *(\([Cc]\)|©|[0-9])|\([Cc]\)|©)[^\n]*"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F‘’“”–—…«»©®]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a unit must hold to be looked up within a text.
MENTION = "licen[sc]|gnu |redistribut"
_ANY = "(?:^|[ \n])(?:" + "|".join(a for a, _ in SPELLINGS) + ")(?:[ \n]|$)"


def _plain(text: Column) -> Column:
    """Lower case without punctuation and copyright lines; line ends stay."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "\n")
    return F.regexp_replace(F.translate(bare, UPPER, LOWER), PUNCTUATION, " ")


def _spelled(plain: Column) -> Column:
    """Words, one blank between them, in one spelling; the text is split only where a spelling may change."""
    spaced = F.trim(F.regexp_replace(plain, "[ \n]+", " "))
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    words = F.transform(F.split(spaced, " "), lambda w: F.coalesce(F.element_at(table, w), w))
    return F.when(plain.rlike(_ANY), F.array_join(words, " ")).otherwise(spaced)


def canonical(text: Column) -> Column:
    return _spelled(_plain(text))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known(docs: DataFrame, texts: tuple[tuple[str, str], ...] = LICENCES) -> DataFrame:
    """(license_id, sha256) of known texts, a row for each digest."""
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("t")) for i, t in texts])
    own = docs.sparkSession.range(1).select(F.explode(rows).alias("x")).select("x.id", digest(canonical(F.col("x.t"))).alias("sha256"))
    return own.groupBy("sha256").agg(F.min("id").alias("license_id"))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, canonical_sha256 (of the entire text), license_id, unit (text, paragraph or line), notices (all found, joined)."""
    plain = docs.select("doc_id", _plain(F.col("text").cast("string")).alias("p"))
    own = plain.select("doc_id", digest(F.col("p")).alias("row"), _spelled(F.col("p")).alias("c"), F.when(F.col("p").rlike(MENTION), F.col("p")).alias("p"))
    own = own.select("doc_id", "row", "p", digest(F.col("c")).alias("canonical_sha256"))
    table = known(docs, LICENCES + NOTICES)
    # Few texts speak of licences at all; only those are split, and rows of one id and text are looked up once.
    part = lambda name, sign: F.transform(F.split("p", sign), lambda x: F.struct(F.lit(name[0]).alias("rank"), F.lit(name[1]).alias("unit"), x.alias("t")))
    some = own.where("p is not null").dropDuplicates(["doc_id", "row"])
    units = some.select("doc_id", "row", F.explode(F.concat(part((1, "paragraph"), "\n[ \n]*\n"), part((2, "line"), "\n"))).alias("u"))
    keyed = units.where(F.col("u.t").rlike(MENTION)).select("doc_id", "row", "u.rank", "u.unit", digest(_spelled(F.col("u.t"))).alias("sha256"))
    whole = some.select("doc_id", "row", F.lit(0).alias("rank"), F.lit("text").alias("unit"), F.col("canonical_sha256").alias("sha256"))
    # The known digests are as many as the texts above, a few hundred.
    hits = keyed.unionByName(whole).join(F.broadcast(table), "sha256")
    best = hits.groupBy("doc_id", "row").agg(F.min(F.struct("rank", F.col("license_id").alias("id"), "unit")).alias("best"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    found = best.select(F.col("doc_id").alias("doc"), F.col("row").alias("text"), F.col("best.id").alias("inner_id"), "best.unit", "notices")
    looked = own.join(F.broadcast(table).select(F.col("sha256").alias("canonical_sha256"), F.col("license_id").alias("whole_id")), "canonical_sha256", "left")
    out = looked.join(found, looked["doc_id"].eqNullSafe(found["doc"]) & (looked["row"] == found["text"]), "left")
    by_whole = F.when(F.col("whole_id").isNotNull(), F.lit("text"))
    return out.select("doc_id", "canonical_sha256", F.coalesce("whole_id", "inner_id").alias("license_id"), F.coalesce(by_whole, "unit").alias("unit"), F.coalesce("notices", "whole_id", F.lit("")).alias("notices"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_plain(x: str) -> str:
    return f"regexp_replace(translate(regexp_replace(coalesce({x}, ''), {_sql(COPYRIGHT_LINE)}, chr(10), 'g'), '{UPPER}', '{LOWER}'), {_sql(PUNCTUATION)}, ' ', 'g')"


def _sql_spelled(p: str) -> str:
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in SPELLINGS)
    spaced = f"trim(regexp_replace({p}, '[ \\n]+', ' ', 'g'), ' ')"
    return f"array_to_string(list_transform(string_split({spaced}, ' '), lambda w: case w {cases} else w end), ' ')"


ORACLE_SQL = f"""
with known as (
  select sha256(c) as h, min(id) as id from (select id, {_sql_spelled("p")} as c from (select id, {_sql_plain("t")} as p from (values {", ".join(f"({_sql(i)}, {_sql(t)})" for i, t in LICENCES + NOTICES)}) v(id, t))) group by 1),
docs as (select doc_id, {_sql_plain("text")} as p from documents),
whole as (select doc_id, p, sha256({_sql_spelled("p")}) as h from docs),
units as (
  select doc_id, p, 0 as rank, 'text' as unit, h from whole
  union all
  select doc_id, p, rank, unit, sha256({_sql_spelled("t")}) from (
    select doc_id, p, 1 as rank, 'paragraph' as unit, unnest(string_split_regex(p, '\\n[ \\n]*\\n')) as t from docs where regexp_matches(p, '{MENTION}')
    union all
    select doc_id, p, 2, 'line', unnest(string_split(p, chr(10))) from docs where regexp_matches(p, '{MENTION}')) where regexp_matches(t, '{MENTION}')),
hits as (select doc_id, p, rank, unit, id from units join known using (h)),
best as (select doc_id, p, min((rank, id, unit)) as b, string_agg(distinct id, ',' order by id) as notices from hits group by 1, 2)
select w.doc_id, w.h as canonical_sha256, b.b[2] as license_id, b.b[3] as unit, coalesce(b.notices, '') as notices
from whole w left join best b on b.doc_id is not distinct from w.doc_id and b.p = w.p
"""
