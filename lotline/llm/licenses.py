"""Licence scan by canonical digests, in SQL functions only.

A text becomes canonical by dropping copyright notice lines, lower-casing, taking
punctuation and white space as one space, and writing equivalent spellings one
way.  The SHA-256 digests of whole documents and of their whole lines are
joined to the digests of known licence texts and notices by hash.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known digests are broadcast up to this number, else joined by a shuffle.
BROADCAST_TEXTS = 100_000

#: Words behind "copyright" that speak of the right itself: licence prose, not a notice line, wherever it is wrapped.
TERMS = ("and", "holder", "holders", "interest", "interests", "law", "laws", "licence", "licences", "license", "licenses",
         "notice", "notices", "or", "owner", "owners", "statement", "statements", "treaty")


def _name_except(words: tuple[str, ...]) -> str:
    """A pattern of words with a capital first letter other than ``words``, in the syntax of both Java and RE2 (no lookahead)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    ways = []
    for start in sorted({w[:k] for w in words for k in range(len(w) + 1)}):
        after = {w[len(start)] for w in words if w.startswith(start) and len(w) > len(start)}
        other = "".join(c for c in letters if c not in after)
        lead = "".join(f"[{c.upper()}{c}]" if k else c.upper() for k, c in enumerate(start))
        if not start:
            ways.append(f"[{other.upper()}\\x{{C0}}-\\x{{10FFFF}}]")
        else:
            ways.append(f"{lead}[{other}{other.upper()}\\x{{C0}}-\\x{{10FFFF}}]")
            if start not in words:
                ways.append(f"{lead}([^\\p{{L}}\\n]|$)")
    return f"({'|'.join(ways)})"


_YEAR = "[<{\\[]*([0-9]{4}|(?i:y{2,4}|years?))\\b"
#: A notice line: the word and (c), ©, a year or a holder; or one of the signs and a year, the word or a short name.
COPYRIGHT = ("(?m)^[^\\p{L}\\p{N}\\n]*("
             f"(?i:copyright)[ \\t:,-]*(\\((?i:c)\\)|©|{_YEAR})|(?i:copyright)[ \\t:-]+(?i:by[ \\t]|the[ \\t]+authors\\b)"
             f"|(?i:copyright)[ \\t:-]+((?i:the)[ \\t]+)?{_name_except(TERMS)}"
             f"|©|\\((?i:c)\\)[ \\t]*((?i:copyright)|©|{_YEAR}|([A-Z][^ \\t\\n]*[ \\t\\r]*){{1,6}}$))[^\\n]*$")
#: Equivalent spellings: endings by pattern, then words by plain replacement.
ENDINGS = "([a-z]{2})is(e|ed|es|er|ers|ing|ation|ations)\\b"
SPELLINGS = {"licenc": "licens", "favour": "favor", "labour": "labor", "judgement": "judgment",
             "acknowledgement": "acknowledgment", "whilst": "while", "centre": "center", "catalogue": "catalog",
             "artefact": "artifact", "offence": "offense", "wilful": "willful", "fulfil ": "fulfill ",
             "sub licens": "sublicens", "non commercial": "noncommercial", "per cent": "percent", "https": "http"}

#: SPDX identifiers with a licence text (a line a paragraph) or usual notice.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
    'associated documentation files (the "Software"), to deal in the Software without restriction, including '
    'without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell '
    'copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the'
    ' following conditions:\n'
    'The above copyright notice and this permission notice shall be included in all copies or substantial '
    'portions of the Software.\n'
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    'LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN '
    'NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
    'WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE '
    'SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.')
_ISC = (
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is '
    'hereby granted, provided that the above copyright notice and this permission notice appear in all '
    'copies.\n'
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    'INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE '
    'FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM '
    'LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, '
    'ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.')
_LONG = {path.name.removesuffix(".txt"): path.read_text(encoding="utf-8")
         for path in sorted((files("lotline.llm") / "licence_texts").iterdir(), key=lambda path: path.name) if path.name.endswith(".txt")}
#: Titles that stand above a text.
_TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
           "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"), "Zlib": ("zlib License", "The zlib License"),
           "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
           "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"), "Unlicense": ("The Unlicense",)}
#: Notices are a lead, with or without "the" or "the terms of the", and a name.
_LEADS = ("Licensed", "Released", "Distributed", "Published", "Available", "This work is licensed", "This software is licensed",
          "This project is licensed", "This program is licensed", "This file is licensed", "This document is licensed")
_NAMES = {
    "MIT": ("MIT License", "MIT"), "ISC": ("ISC License", "ISC"), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "0BSD": ("Zero-Clause BSD License", "0BSD"), "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License"),
    **{f"{kind}{number}.0-{which}": tuple(f"{name}{end}" for name in (
        *(f"GNU {word}General Public License{sep}{number}" for sep in (", version ", " v", " ")), f"GNU {kind[:-1]} version {number}",
        f"GNU {kind[:-1]} v{number}", f"{kind[:-1]}v{number}") for end in ends)
       for kind, word, number in (("GPL-", "", 2), ("GPL-", "", 3), ("LGPL-", "Lesser ", 3), ("AGPL-", "Affero ", 3))
       for which, ends in (("only", ("", ".0", " only")), ("or-later", (" or later", ".0 or later", " or any later version", " or (at your option) any later version")))},
    **{f"CC-{short}-4.0": (f"CC {short} 4.0", f"Creative Commons {name} 4.0 International License", f"Creative Commons {name} 4.0 License")
       for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                           ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                           ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}


def _between(text: str, start: str, end: str) -> str:
    return text[text.index(start):text.index(end, text.index(start)) + len(end)]


def _texts() -> Iterator[tuple[str, str]]:
    """Whole texts as they are published, in their usual variants, and the headers of files under the long ones."""
    whole = [("MIT", _MIT), ("ISC", _ISC), *_LONG.items()]
    for name, text in list(whole):
        if name.startswith("BSD-"):  # items numbered or not; "holder" and "owner" are both usual
            for items in (text, re.sub(r"(?m)^[123]\. ", "", text)):
                whole += [(name, re.sub("COPYRIGHT\\s+(HOLDER|OWNER)\\s+OR", f"COPYRIGHT {who} OR", items)) for who in ("HOLDER", "OWNER")]
        if "END OF TERMS AND CONDITIONS" in text:  # without the advice behind the terms
            terms = text[:text.index("END OF TERMS AND CONDITIONS")]
            whole += [(name, terms), (name, terms + "END OF TERMS AND CONDITIONS")]
    for name, text in whole:
        yield name, text
        if re.search(r"(?im)^\W*copyright (\(c\)|\[)", text):  # on one line, where the notices inside do not begin lines
            yield name, " ".join(text.split())
        for title in _TITLES.get(name, ()):
            yield name, f"{title}\n{text}"
            yield name, f"{title}\nAll rights reserved.\n{text}"
        if name in _TITLES:
            yield name, f"All rights reserved.\n{text}"
    yield "Apache-2.0", _between(_LONG["Apache-2.0"], "Licensed under the Apache", "limitations under the License.")
    mozilla = _between(_LONG["MPL-2.0"], "This Source Code Form is subject to the terms of the Mozilla", "mozilla.org/MPL/2.0/.")
    yield from (("MPL-2.0", mozilla), ("MPL-2.0", mozilla.replace("http:", "https:")))
    either = _between(_LONG["GPL-3.0-only"], "This program is free software: you", "<https://www.gnu.org/licenses/>.")
    for kind, word, number in (("GPL-", "", 2), ("GPL-", "", 3), ("LGPL-", "Lesser ", 3), ("AGPL-", "Affero ", 3)):
        later = either.replace("GNU General", f"GNU {word}General").replace("version 3", f"version {number}")
        yield f"{kind}{number}.0-or-later", later
        yield f"{kind}{number}.0-only", re.sub(r"either (version \d of the License), or\s+\(at your option\) any later version", r"\1", later)


def _known() -> Iterator[tuple[str, str]]:
    yield from _texts()
    for name in sorted({*_NAMES, *_LONG}):
        yield name, f"SPDX-License-Identifier: {name}"
    for name, called in _NAMES.items():
        for what in dict.fromkeys(called):
            for lead in _LEADS:
                yield from ((name, f"{lead} under {article}{what}.") for article in ("", "the ", "the terms of the "))
                if what.startswith("Creative"):
                    yield name, f"{lead} under a {what}."


KNOWN = tuple(dict.fromkeys(_known()))


def known_licences(spark: SparkSession) -> DataFrame:
    """``(license_id, text)``: whole texts, file headers, notices and tags of the licences above."""
    return spark.createDataFrame(list(KNOWN), "license_id string, text string")


def canonical(text: Column) -> Column:
    """The canonical form of a text; null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, " ")
    out = F.trim(F.regexp_replace(F.lower(out), "[^\\p{L}\\p{N}]+", " "))
    out = F.regexp_replace(out, ENDINGS, "$1iz$2")
    for other, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(other), F.lit(usual))
    return out


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, canonical_sha256, license_id, n_lines, licenses.

    ``license_id`` is that of the known text that the whole document equals
    (the first by name, if several share a digest), else null; ``n_lines``
    counts the lines that equal a known text, and ``licenses`` has the sorted
    distinct identifiers of both.  A known text whose canonical form is empty
    matches nothing.  Null texts are empty and match nothing; repeated rows and
    null ids are scanned each by itself; other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    digest = lambda c: F.sha2(canonical(c), 256)
    digests = (known_licences(spark) if known is None else known).where(canonical(F.col("text")) != "").groupBy(
        digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license"))
    if digests.count() <= BROADCAST_TEXTS:
        digests = F.broadcast(digests)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    # unit 0 is the whole text, the others its lines
    lines = F.when(F.col("text").contains("\n"), F.split("text", "\r?\n")).otherwise(F.array("text"))
    units = rows.select("row", "id", F.posexplode(F.concat(F.array("text"), lines)).alias("unit", "part"))
    found = units.select("row", "id", "unit", digest(F.col("part")).alias("digest")).join(digests, "digest", "left").where(
        "unit = 0 or license is not null")
    return (found.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.max(F.when(F.col("unit") == 0, F.col("digest"))).alias("canonical_sha256"),
        F.max(F.when(F.col("unit") == 0, F.col("license"))).alias("license_id"),
        F.sum(F.when(F.col("unit") > 0, 1).otherwise(0)).cast("long").alias("n_lines"),
        F.array_sort(F.collect_set("license")).alias("licenses"))
        .drop("row"))
