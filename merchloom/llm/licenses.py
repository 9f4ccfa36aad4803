"""Licence scan: entire texts joined to known licences by the digest of their canonical form.

The canonical form is lower case without copyright lines, with one spelling of words that are written in
several ways, and with single blanks for all punctuation and white space. A text that equals a licence but
for these has its digest. Besides whole texts, every line is looked up as a text of its own, which finds
notices that stand in a line of a longer document.

Known texts are a table ``license, text``: ``known_licenses`` reads one from a path, or gives the built-in
``KNOWN``. That holds whole licences, each with the forms in which it usually stands in a file, and notices.
"""

from __future__ import annotations

import re
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchloom.llm.license_texts import TEXTS

# Spellings that count as equal, from the public matching guidelines for licence texts.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "centre": "center", "favour": "favor", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "licence": "license", "maximise": "maximize", "noninfringement": "non infringement",
    "optimise": "optimize", "organisation": "organization", "owner": "holder", "per cent": "percent", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "sub license": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Public licence texts and notices.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_SHORT = (
    ("MIT", f"MIT License\n\nCopyright (c) <year> <copyright holders>\n\n{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice "
            f"and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\nCopyright <year> <copyright holders>\n\n{_PERMISSION}.\n\n{_WARRANTY}"),
    ("ISC", "ISC License\n\nCopyright (c) <year> <copyright holders>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
            f"\n\n{_ISC_WARRANTY}"),
    ("0BSD", "BSD Zero Clause License\n\nCopyright (c) <year> <copyright holders>\n\nPermission to use, copy, modify, and/or distribute this software for "
             f"any purpose with or without fee is hereby granted.\n\n{_ISC_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY {by} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {liable} BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission.")
_BSD_PARTIES = (("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"),
                ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS"),
                ("THE AUTHOR AND CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS"), ("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"))


def _bsd() -> list[tuple[str, str]]:
    """BSD licences with and without title and numbers, for the usual names of the parties."""
    titles = {2: ("", "BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "Simplified BSD License"),
              3: ("", "BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License")}
    owners = ("the copyright holder", "the copyright holders", "the author", "the University", "<organization>", "the <organization>")
    out = []
    for clauses, numbered, (by, liable) in product((2, 3), (True, False), _BSD_PARTIES):
        for title, who in product(titles[clauses], owners if clauses == 3 else ("",)):
            points = [f"{i}. {c}" if numbered else f"* {c}" for i, c in enumerate(_BSD_CLAUSES[:clauses], 1)]
            out.append((f"BSD-{clauses}-Clause", "\n\n".join([
                title, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                "conditions are met:", *points, _BSD_WARRANTY.format(by=by, liable=liable)]).format(who=who)))
    return out


def _forms(name: str, text: str) -> list[tuple[str, str]]:
    """A whole licence as published, without the part on how to use it, and with the older addresses and titles."""
    forms = [text]
    if (end := re.search("END OF TERMS AND CONDITIONS", text)):
        forms += [text[:end.end()], text[:end.start()]]
    forms += [re.sub(r"(?m)^ *Copyright \[yyyy\].*\n", "", f) for f in forms[:1] if "[yyyy]" in f]
    address = r"51 Franklin St(reet)?, Fifth Floor,\s+Boston, MA\s+02110-1301,?\s+USA"
    forms += [re.sub(address, new, f) for f in forms if re.search(address, f)
              for new in ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")]
    title = {"Unlicense": "The Unlicense", "Zlib": "zlib License"}.get(name)
    return [(name, f) for f in forms] + [(name, f"{title}\n\n{f}") for f in forms if title]


# Names under which notices give a licence; the first is its identifier.
_NAMES = {
    "MIT": ("MIT", "MIT License", "Expat License"),
    "ISC": ("ISC", "ISC License"),
    "Apache-2.0": ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2.0",
                   "Apache License, Version 2.0 (the \"License\")"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause License", "BSD-3-Clause License", "New BSD License", "Modified BSD License"),
    "GPL-2.0": ("GPL-2.0-only", "GPL-2.0", "GPLv2", "GPL v2", "GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GNU GPLv2"),
    "GPL-2.0-or-later": ("GPL-2.0-or-later", "GNU General Public License, version 2 or later"),
    "GPL-3.0": ("GPL-3.0-only", "GPL-3.0", "GPLv3", "GPL v3", "GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPLv3"),
    "GPL-3.0-or-later": ("GPL-3.0-or-later", "GNU General Public License, version 3 or later"),
    "LGPL-2.1": ("LGPL-2.1-only", "LGPL-2.1", "LGPLv2.1", "LGPL v2.1", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-2.1-or-later": ("LGPL-2.1-or-later", "GNU Lesser General Public License, version 2.1 or later"),
    "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0", "LGPLv3", "LGPL v3", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "LGPL-3.0-or-later": ("LGPL-3.0-or-later", "GNU Lesser General Public License, version 3 or later"),
    "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0", "AGPLv3", "AGPL v3", "GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "AGPL-3.0-or-later": ("AGPL-3.0-or-later", "GNU Affero General Public License, version 3 or later"),
    "MPL-1.1": ("MPL-1.1", "Mozilla Public License, version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "Zlib": ("Zlib", "zlib License"),
    "BSL-1.0": ("BSL-1.0", "Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "0BSD": ("0BSD", "BSD Zero Clause License"),
    "MIT-0": ("MIT-0", "MIT No Attribution"),
    "GFDL-1.2": ("GFDL-1.2-only", "GFDL-1.2", "GNU Free Documentation License, version 1.2"),
    "GFDL-1.3": ("GFDL-1.3-only", "GFDL-1.3", "GNU Free Documentation License, version 1.3"),
    **{f"CC-{kind}-{version}": (
        f"CC-{kind}-{version}", f"CC {kind} {version}", f"Creative Commons {long} {version} International License", f"Creative Commons {long} {version} License")
       for kind, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                          ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for version in ("3.0", "4.0")},
}
_NOTICES = ("{v} under {n}", "{v} under the {n}", "{v} under the terms of {n}", "{v} under the terms of the {n}", "{s} is {v} under {n}", "{s} is {v} under the {n}",
            "{s} is {v} under the terms of the {n}", "{v} under a {n}", "{s} is {v} under a {n}")
_VERBS, _SUBJECTS = ("licensed", "released", "distributed"), ("This work", "This project", "This software", "This program", "This file")


def _notices() -> list[tuple[str, str]]:
    """Standard one-line notices: machine-read tags, and the usual sentences with every name of a licence."""
    out = []
    for name, names in _NAMES.items():
        out += [(name, f"{tag}: {n}") for n in names for tag in ("SPDX-License-Identifier", "License")]
        for n, form, v in product(names, _NOTICES, _VERBS):
            out += [(name, form.format(n=n, v=v, s=s)) for s in (_SUBJECTS if "{s}" in form else ("",))]
    return out


# The whole headers that licences ask to put into files, should they stand in one line.
_HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    *[(f"{short}-{number}-or-later", f"{what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as "
       f"published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.")
      for short, kind, number, version in (("GPL", "", "2.0", "2"), ("GPL", "", "3.0", "3"), ("LGPL", "Lesser ", "2.1", "2.1"), ("LGPL", "Lesser ", "3.0", "3"),
                                           ("AGPL", "Affero ", "3.0", "3"))
      for what, mark, comma in product(("This program", "This library"), (":", ";"), (",", ";"))],
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0 OR MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
)
KNOWN: tuple[tuple[str, str], ...] = (*_SHORT, *[form for name, text in TEXTS for form in _forms(name, text)], *_bsd(), *_HEADERS, *_notices())

_COPYRIGHT_LINE = "^[^\\p{L}\\p{N}]*(copyright +(\\(c\\)|©|[0-9<]|by )|\\(c\\) |© *|all rights reserved[.]?$)"


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form; lines without a letter or digit are empty."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda line: ~F.rlike(F.trim(line), F.lit(_COPYRIGHT_LINE)))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "[^\\p{L}\\p{N}\\n]+", " ")
    for word, same in EQUIVALENT.items():
        joined = F.replace(joined, F.lit(word), F.lit(same))
    return F.transform(F.split(joined, "\n"), lambda line: F.trim(line))


def canonical(lines: Column) -> Column:
    """One line of canonical text."""
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def known_licenses(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``license, text``: a Parquet table of the user's own, or the built-in texts."""
    if path is not None:
        return spark.read.parquet(path).select("license", "text")
    names, texts = zip(*dict.fromkeys(KNOWN), strict=True)
    return spark.createDataFrame(pa.table({"license": names, "text": texts}))


def known_digests(known: DataFrame, name_col: str = "license", text_col: str = "text") -> DataFrame:
    """``digest, license``: one row per canonical form; of several names the first counts."""
    digest = F.sha2(canonical(canonical_lines(F.col(text_col))).cast("binary"), 256)
    return known.select(digest.alias("digest"), F.col(name_col).alias("license")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, license, notices, notice_lines`` for every row of ``docs``.

    ``license`` is that of the whole text, ``notices`` are the distinct licences of its lines. A null text
    is empty; the empty form is no licence. Texts are read once: their lines' digests, and the whole
    text's at place -1, meet the known ones; of the lines only known ones reach the shuffle.
    """
    forms = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    numbered = F.transform("lines", lambda line, at: F.struct(at.alias("place"), line.alias("line")))
    units = F.transform(F.filter(numbered, lambda u: u["line"] != ""), lambda u: F.struct(u["place"].alias("place"), digest(u["line"]).alias("digest")))
    whole = F.struct(F.lit(-1).alias("place"), digest(canonical(F.col("lines"))).alias("digest"))
    # rows that share an id are parted by their text; rows that share both are counted and given back
    rows = forms.select("doc_id", F.xxhash64("lines").alias("row"), F.explode(F.array_append(units, whole)).alias("unit"))
    met = rows.select("doc_id", "row", "unit.*").join(known_digests(known), "digest", "left").where("place = -1 OR license IS NOT NULL")
    is_whole, line = F.col("place") == -1, F.when(F.col("place") >= 0, F.col("license"))
    grouped = met.groupBy("doc_id", "row").agg(
        F.max(F.when(is_whole, F.col("digest"))).alias("digest"), F.max(F.when(is_whole, F.col("license"))).alias("license"),
        F.collect_set(line).alias("found"), F.size(F.collect_set(F.when(~is_whole, F.col("place")))).cast("long").alias("notice_lines"),
        F.sum(is_whole.cast("long")).alias("copies"))
    notices = F.when(F.size("found") > 0, F.array_join(F.array_sort("found"), ","))
    return grouped.select("doc_id", "digest", "license", notices.alias("notices"), "notice_lines", F.explode(
        F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def oracle() -> str:
    """SQL for the rows of ``scan`` over the table ``documents``."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    spelled = r"regexp_replace(array_to_string(lines, chr(10)), '[^\p{L}\p{N}\n]+', ' ', 'g')"
    for word, same in EQUIVALENT.items():
        spelled = f"replace({spelled}, {quoted(word)}, {quoted(same)})"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
WITH raw AS (
  SELECT 'doc' AS kind, row_number() OVER () AS n, doc_id, NULL AS license, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'known', row_number() OVER (), NULL, license, text FROM (VALUES {known}) k(license, text)
), split AS (
  SELECT kind, n, doc_id, license,
         [x for x in string_split(lower(text), chr(10)) if NOT regexp_matches(trim(x), {quoted(_COPYRIGHT_LINE)})] AS lines
  FROM raw
), forms AS (
  SELECT kind, n, doc_id, license, [trim(x) for x in string_split({spelled}, chr(10))] AS lines FROM split
), whole AS (
  SELECT *, sha256(array_to_string([x for x in lines if x <> ''], ' ')) AS digest FROM forms
), known AS (
  SELECT digest, min(license) AS license FROM whole WHERE kind = 'known' GROUP BY digest
), line AS (
  SELECT n, unnest([sha256(x) for x in lines if x <> '']) AS digest FROM whole WHERE kind = 'doc'
), notice AS (
  SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS notice_lines FROM line JOIN known USING (digest) GROUP BY n
)
SELECT w.doc_id, w.digest, k.license, o.notices, CAST(coalesce(o.notice_lines, 0) AS BIGINT) AS notice_lines
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notice o USING (n) WHERE w.kind = 'doc'
"""
