"""Canonical digests: what counts as equal and what does not."""

from merchloom.llm import license_texts, licenses


def scan(spark, texts):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, license string, digest int")
    return {r.doc_id: r for r in licenses.scan(frame, licenses.known_licenses(spark)).collect()}


def test_variants_have_the_licence(spark):
    text = next(t for n, t in licenses.KNOWN if n == "MIT")
    variants = [text, text.upper(), text.replace("<year> <copyright holders>", "1999-2024 Some One, Inc."), " ".join(text.split("\n\n")[2:]),
                text.replace("\n\n", "\n").replace("(the", "\n(the").replace('"', "“"), text.replace("HOLDERS", "OWNERS"), text + "\n\nAll rights reserved."]
    got = scan(spark, variants)
    assert [got[i].license for i in (0, 1, 2, 4, 5, 6)] == ["MIT"] * 6
    assert got[3].license is None  # the title is a part of the text
    assert scan(spark, [text.replace("free of charge", "for a fee"), text + " And more."])[0].license is None


def test_notices_in_lines(spark):
    got = scan(spark, ["some prose\n# Licenced under the Apache Licence, version 2.0\nmore", "Released under the MIT License.",
                       "released under the mit license\nLicensed under the MIT license!\nThis work is licensed under the GNU General Public License, version 3."])
    assert (got[0].license, got[0].notices, got[0].notice_lines) == (None, "Apache-2.0", 1)
    assert (got[1].license, got[1].notices) == ("MIT", "MIT")
    assert (got[2].license, got[2].notices, got[2].notice_lines) == (None, "GPL-3.0,MIT", 3)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n ?!"), (4, "Copyright (c) 2020 Me"), (5, "word " * 50_000), (None, "Released under the MIT License."),
            (7, "Licensed under CC BY 4.0.\nx"), (7, "Licensed under CC BY 4.0.\nx"), (7, "other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(frame, licenses.known_licenses(spark))
    got = found.collect()
    assert len(got) == len(rows)
    assert len({r.digest for r in got if r.doc_id in (1, 2, 3, 4)}) == 1
    assert sorted(r.notice_lines for r in got if r.doc_id == 7) == [0, 1, 1]
    assert [r.license for r in got if r.doc_id is None] == ["MIT"]
    assert licenses.scan(frame.limit(0), licenses.known_licenses(spark)).count() == 0


def test_whole_texts_of_common_licences(spark):
    texts = dict(license_texts.TEXTS)
    apache, gpl = texts["Apache-2.0"], texts["GPL-2.0"]
    cases = [(name, text) for name, text in license_texts.TEXTS]
    cases += [(name, " ".join(text.upper().split())) for name, text in license_texts.TEXTS if name in ("Unlicense", "BSL-1.0")]
    cases += [("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Some One")),
              ("Apache-2.0", apache[:apache.index("APPENDIX")]), ("GPL-2.0", gpl[:gpl.index("How to Apply")]),
              ("GPL-2.0", gpl.replace("51 Franklin Street, Fifth Floor,\n Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"))]
    bsd = """BSD 3-Clause License

Copyright (c) 2015, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
    points = [p for p in bsd.split("\n\n") if not p.startswith("* Neither")]
    cases += [("BSD-3-Clause", bsd), ("BSD-2-Clause", "\n\n".join(points).replace("BSD 3", "BSD 2")), (None, apache.replace("perpetual", "temporary"))]
    got = scan(spark, [text for _, text in cases])
    assert [(i, got[i].license) for i in range(len(cases))] == [(i, name) for i, (name, _) in enumerate(cases)]


def test_other_wordings_of_notices(spark):
    lines = {"// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "This project is licensed under the MIT License": "MIT", "Distributed under the GPLv3.": "GPL-3.0",
             "Released under the terms of the GNU Lesser General Public License, version 2.1 or later.": "LGPL-2.1-or-later", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
             ' * Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0", "This software is released under the Unlicense.": "Unlicense",
             "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0", "We are licensed to sell fish": None}
    got = scan(spark, [f"prose\n{line}\nprose" for line in lines])
    assert [got[i].notices for i in range(len(lines))] == list(lines.values())


def test_known_texts_from_a_path(spark, tmp_path):
    path = str(tmp_path / "known")
    spark.createDataFrame([("House-1", "Ours. All of it.")], "license string, text string").write.parquet(path)
    docs = spark.createDataFrame([(1, "ours, all of it"), (2, "SPDX-License-Identifier: MIT")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_licenses(spark, path)).collect()} == {1: "House-1", 2: None}
