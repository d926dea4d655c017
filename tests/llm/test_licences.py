import os

import pytest
from compare import check, duck

from duologue.llm import licences
from duologue.llm.queries import QUERIES, SQL
from duologue.plans.registry import Query

SF = "/root/testdata/sf0.001"


def whole(name):
    """A licence's text, from its sentences."""
    ids = next(r for lic, r in licences.RULES if lic == name)
    return "\n".join(licences.SENTENCES[i][0] for i in ids)


def test_rules(spark):
    bsd = "  * ".join(licences.SENTENCES[i][0] + "\n" for i in ("bsdGrant", "bsdSource", "bsdBinary", "bsdName"))
    rows = [(1, whole("MIT")), (2, whole("Apache-2.0").upper().replace(" ", "  ")), (3, whole("GPL-3.0-or-later")), (4, bsd),
            (5, "Words.\nReleased under the MIT License.\nMore words. All rights reserved. End"), (6, None), (7, ""),
            (8, licences.SENTENCES["mitNotice"][0]), (9, "x. " * 50_000 + "Released under the MIT License."),
            (10, "Released under the MIT License.\n" * 3), (None, "Licensed under CC BY-NC 4.0."), (11, "I Released under the MIT License.")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, licences string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert {d: r.licences for d, r in got.items()} == {
        1: "MIT", 2: "Apache-2.0", 3: "GPL-3.0-or-later", 4: "BSD-3-Clause", 5: "LicenseRef-all-rights-reserved AND MIT", 6: "", 7: "",
        8: "", 9: "MIT", 10: "MIT", None: "CC-BY-NC-4.0", 11: ""}
    assert got[8].unmatched == "<mitNotice>" and got[10].n_sentences == 3 and got[1].unmatched == ""
    assert licences.scan(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    status, rows, _, note = check(spark, duck(SF), name, Query(name, QUERIES[name], SQL[name]), SF)
    assert status == "ok" and rows > 0, note


def wrapped(name, width, lead="", start=""):
    """A licence's text as files have it: filled lines with a comment leader, a blank line between some paragraphs."""
    import textwrap

    ids = next(r for lic, r in licences.RULES if lic == name)
    paragraphs = [licences.SENTENCES[i][0] for i in ids]
    return start + "\n".join(lead + line for p in paragraphs for line in [*textwrap.wrap(p, width), ""])


APACHE = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
GPL = """;; This program is free software: you can redistribute it and/or modify
;; it under the terms of the GNU General Public License as published by
;; the Free Software Foundation, either version 3 of the License, or
;; (at your option) any later version.
;;
;; This program is distributed in the hope that it will be useful,
;; but WITHOUT ANY WARRANTY; without even the implied warranty of
;; MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
;; GNU General Public License for more details.
"""


def test_wrapped_texts(spark):
    rows = [(1, wrapped("MIT", 76)), (2, wrapped("BSD-3-Clause", 70, " * ", "/*\r\n").replace("\n", "\r\n")), (3, wrapped("ISC", 72, "// ")),
            (4, APACHE), (5, GPL), (6, "Project\nReleased under the MIT License.\nThanks"),
            (7, "*" * 3000 + " Released under the MIT License. " + "-" * 3000),
            (8, "Released under\n\nanother name. The MIT License."), (9, "Released under\nthe MIT\nlicence"),
            (10, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"),
            (11, 'Licensed under the Apache License, Version 2.0\n(the "License");\nyou may not use this file except in\ncompliance with the License.'),
            (12, "Released under\nRELEASED UNDER THE\nMIT LICENSE.")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.licences for d, r in got.items()} == {
        1: "MIT", 2: "BSD-3-Clause", 3: "ISC", 4: "Apache-2.0", 5: "GPL-3.0-or-later", 6: "MIT", 7: "MIT", 8: "", 9: "",
        10: "MPL-2.0", 11: "Apache-2.0", 12: "MIT"}
    assert all(got[d].unmatched == "" for d in (1, 2, 3, 4, 5))
    assert got[10].sequence == "<mpl2_1><mpl2>"
