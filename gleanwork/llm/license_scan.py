"""Licence scan by digest of the canonical text, with built-in functions only.

A text is made canonical by the rules below, in order: case, copyright lines, equivalent
spellings, punctuation, white space. The SHA-256 of the whole canonical text is looked up
among the digests of known licence texts by a hash join; in it a copyright notice also ends
where a licence's first words begin, so neither its lines nor its wording matter. The lines are
looked up in the same way, so a licence notice inside a document is found as well as a document
that is nothing but a licence.

Only digests move. While the known ones are at most BROADCAST_ROWS (checked) they are
broadcast and no line is shuffled; beyond that both sides of the join are dealt by digest.

Edge cases: null and empty texts, and texts with no letter or digit, have the digest of the
empty text and match nothing; of licences with one canonical text the first name wins;
rows that repeat doc_id and canonical text give one row; a repeated line counts once; an
empty table gives no rows; other columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

import json
import operator
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import documents, staged, table

#: Up to so many known digests (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 20_000

#: Names that notices use for a licence.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "MIT-0": ["MIT No Attribution License", "MIT-0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "Zlib": ["zlib License", "zlib"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL 2.0", "EPL-2.0"],
    **{f"{short}-{n}.0": [f"GNU {long} General Public License, Version {n}".replace("  ", " "), f"GNU {long} General Public License, Version {n}.0".replace("  ", " "), f"GNU {long} General Public License v{n}.0".replace("  ", " "), f"GNU {short} v{n}", f"GNU {short} {n}.0", f"{short} v{n}", f"{short}v{n}", f"{short} {n}.0", f"{short}-{n}.0"] for short, long, n in (("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser", 3), ("AGPL", "Affero", 3))},
    "LGPL-2.1": ["GNU Lesser General Public License, Version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPL v2.1", "LGPLv2.1", "LGPL 2.1", "LGPL-2.1"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "CC0-1.0"],
    **{f"CC-{part}-{v}": [f"Creative Commons {name} {v} International License", f"Creative Commons {name} {v}", f"CC {part} {v}", f"CC-{part}-{v}"] for v in ("3.0", "4.0") for part, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
#: Wordings of one-line notices around a name.
NOTICES = [f"{verb} under {the}{{}}." for verb in ("Licensed", "Released", "Distributed", "Available", *(f"This {what} is {how}" for what in ("work", "project", "software") for how in ("licensed", "released"))) for the in ("", "the ")] + ["License: {}", "SPDX-License-Identifier: {}"]
#: Titles that stand above, or are left out of, the whole text of a short licence.
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License (ISC)", "ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib License", "The zlib/libpng License", "zlib License (Zlib)"],
    "MIT-0": ["MIT No Attribution"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "Unlicense": ["The Unlicense"],
    "Unicode-3.0": ["UNICODE LICENSE V3"],
}
_END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """(name, text) of the files in licenses/, each named as its licence: with each of its titles and without, with and without the appendix."""
    out = []
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        name, text = file.stem, file.read_text(encoding="utf-8")
        titles = TITLES.get(name, [])
        first, _, rest = text.lstrip().partition("\n")
        body = rest if first.strip() in titles else text
        out += [(name, text), (name, body)] + [(name, f"{title}\n{body}") for title in titles]
        if _END in text:
            out += [(name, text.partition(_END)[0] + _END), (name, text.partition(_END)[0])]
    return out


#: Known notices and whole texts: (name, text).
LICENSES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-1.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    *((name, wording.format(called)) for name, names in NAMES.items() for called in names for wording in NOTICES),
    *whole_texts(),
    (
        "MIT",
        "MIT License\nCopyright (c) 2020 A. Holder\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

# Equivalent spellings, as parts of words; the second form stands for both.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authoris": "authoriz", "behaviour": "behavior", "calibre": "caliber", "cancelled": "canceled",
    "capitalis": "capitaliz", "catalogue": "catalog", "categoris": "categoriz", "centre": "center", "colour": "color", "customis": "customiz", "emphasis": "emphasiz", "favour": "favor",
    "fulfill": "fulfil", "honour": "honor", "initialis": "initializ", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "maximis": "maximiz", "minimis": "minimiz",
    "modelled": "modeled", "modelling": "modeling", "non-commercial": "noncommercial", "non-infringement": "noninfringement", "offence": "offense", "optimis": "optimiz", "organis": "organiz", 
    "practise": "practice", "programme": "program", "realis": "realiz", "recognis": "recogniz", "signalling": "signaling", "sub-license": "sublicense", "utilis": "utiliz",
    "whilst": "while", "wilfull": "willful", "wilful": "willful", "https": "http",
}

#: First words of licences that stand behind a copyright notice, and the length that a notice in front of them may have.
OPENINGS = ["permission is hereby granted", "permission to use copy", "redistribution and use", "this software is provided as is"]
NOTICE_LENGTH = 500
_GAP = r"[^\p{L}\p{N}]+"
#: A notice and the opening behind it, which stays. The text is lower case.
NOTICE = rf"(?s)(?:(?:portions|parts|some) )?(?:copyright|\(c\)|©).{{0,{NOTICE_LENGTH}}}?({'|'.join(_GAP.join(x.split()) for x in OPENINGS)})"

#: Rules of the canonical form, in order: (pattern, replacement, words of which a text that it matches has one). Lines end at \n.
RULES = [
    (r"[\r\t\x0B\f]", " ", ["\r", "\t", "\x0b", "\f"]),
    (r"all\s+rights\s+reserved", " ", ["reserved"]),
    # Lines that are a copyright notice: the word or sign with a year, a sign or a blank for it. Without, they are words of a licence.
    (r"(^|\n)[^\p{L}\p{N}\n]*((?:portions |parts |some )?copyright[^\p{L}\p{N}\n]*(?:c\)|©|[0-9]{4}|yyyy|year)|c\)[^\p{L}\p{N}\n]*(?:copyright|[0-9]{4})|©)[^\n]*", r"\1", ["copyright", "c)", "©"]),
    *((a, b, [a]) for a, b in SPELLINGS.items()),
    (r"copyright\s+owner", "copyright holder", ["owner"]),
    (r"sub\s+license", "sublicense", ["license"]),
    (r"per\s+cent", "percent", ["cent"]),
    # Letters of every script stay, so that a notice in a text of another language is not the whole text.
    (r"[^\p{L}\p{N}\n]+", " ", []),
]


def _where_any(text: Column, words: list[str], change) -> Column:
    """change(text) where text has one of the words: looking for a word costs a small part of replacing it."""
    either = lambda x: reduce(operator.or_, (F.contains(x, F.lit(w)) for w in words))
    return F.transform(F.array(text), lambda x: F.when(either(x), change(x)).otherwise(x))[0]


def _spelled(text: Column) -> Column:
    pairs = F.array(*(F.struct(F.lit(a).alias("of"), F.lit(b).alias("by")) for a, b in SPELLINGS.items()))
    return F.aggregate(pairs, text, lambda t, p: F.when(F.contains(t, p["of"]), F.replace(t, p["of"], p["by"])).otherwise(t))


def canonical_lines(lower: Column) -> Column:
    """The canonical text of a lower-case one, with its line breaks."""
    out, spelled = lower, False
    for pattern, by, words in RULES:
        change = lambda x, pattern=pattern, by=by: F.regexp_replace(x, pattern, by.replace(r"\1", "$1"))
        if pattern not in SPELLINGS:
            out = _where_any(out, words, change) if words else change(out)
        elif not spelled:
            out, spelled = _spelled(out), True
    return out


def canonical_whole(lower: Column, lines: Column) -> Column:
    """The canonical text without line breaks and without notices before an opening; lines is canonical_lines(lower)."""
    flat = lambda x: F.trim(F.regexp_replace(x, "[ \n]+", " "))
    opened = reduce(operator.or_, (F.contains(lower, F.lit(w)) for w in ("copyright", "(c)", "©"))) & lower.rlike(NOTICE)
    return F.when(opened, flat(canonical_lines(F.regexp_replace(lower, NOTICE, "$1")))).otherwise(flat(lines))


def known_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license) of licenses (license, text)."""
    texts = licenses.select("license", F.lower("text").alias("text"))
    forms = texts.select("license", canonical_whole(F.col("text"), canonical_lines(F.col("text"))).alias("form")).where("form != ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """(doc_id, digest, license, n_license_lines, line_licenses).

    license is the licence that the whole text is, else null; n_license_lines counts the
    distinct lines that are known by themselves, line_licenses has their names, comma-joined.
    """
    known = staged(known_digests(licenses), "known-licenses")
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    lower = documents(docs).select("doc_id", F.lower("text").alias("text"))
    forms = lower.select("doc_id", "text", canonical_lines(F.col("text")).alias("form"))
    lines = F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # The whole text's digest is made before its lines are rows, so once a document.
    digests = forms.select("doc_id", F.sha2(canonical_whole(F.col("text"), F.col("form")), 256).alias("digest"), F.array_distinct(F.transform(lines, lambda x: F.sha2(x, 256))).alias("lines"))
    rows = digests.select("doc_id", "digest", F.explode_outer("lines").alias("line"))
    hits = rows.join(known.select(F.col("digest").alias("line"), F.col("license").alias("of_line")), "line", "left")
    per = hits.groupBy("doc_id", "digest").agg(F.size(F.collect_set(F.when(F.col("of_line").isNotNull(), F.col("line")))).cast("long").alias("n_license_lines"), F.array_join(F.sort_array(F.collect_set("of_line")), ",").alias("line_licenses"))
    return per.join(known, "digest", "left").select("doc_id", "digest", "license", "n_license_lines", "line_licenses")


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"license": n, "text": t} for n, t in LICENSES])), "array<struct<license: string, text: string>>"))).repartition(16)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql() -> str:
    """The same in SQL over the table documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = lambda c: (
        "".join("regexp_replace(" for _ in RULES) + c + "".join(f", {quote(p)}, {quote(by)}, 'g')" for p, by, _ in RULES)
    )
    flat = lambda c: "trim(regexp_replace(" + form(f"regexp_replace(lower({c}), {quote(NOTICE)}, '\\1', 'g')") + ", '[ \n]+', ' ', 'g'))"
    listed = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in LICENSES)
    return f"""
with listed(license, txt) as (values {listed}),
known as (select sha256(f) as digest, min(license) as license from (select license, {flat('txt')} as f from listed) where f <> '' group by 1),
forms as (select doc_id, {form("lower(coalesce(text, ''))")} as form, sha256({flat("coalesce(text, '')")}) as digest from documents),
whole as (select distinct doc_id, digest from forms),
lines as (select distinct doc_id, digest, sha256(trim(line)) as line from (select doc_id, digest, unnest(string_split(form, chr(10))) as line from forms) where trim(line) <> ''),
hits as (select l.doc_id, l.digest, count(*) as n, string_agg(distinct k.license, ',' order by k.license) as names from lines l join known k on l.line = k.digest group by 1, 2)
select w.doc_id, w.digest, k.license, coalesce(h.n, 0) as n_license_lines, coalesce(h.names, '') as line_licenses
from whole w left join known k using (digest) left join hits h on h.doc_id = w.doc_id and h.digest = w.digest
"""


ORACLE = _sql()
