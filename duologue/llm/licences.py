"""Licence recognition by sentences: known sentences become identifiers, ordered rules match their sequences.

A text is split into pieces at line ends and after full stops, semicolons and colons; a piece is normalised (lower case, only
letters and digits, one space between words), so comment leaders and banners vanish. A known licence sentence is a piece, or
several pieces in a row that only line ends part: from each piece on, the longest known sentence is taken, so a wrapped
sentence is found as well as a notice that is one line among others. Lines without a letter or digit are passed over, as the
Apache notice has one before its address. The identifiers of a
document, in order, form its sequence. Rules are tried from the longest sequence of identifiers to the shortest, in the order
given; a rule takes every place where its sequence is found, and what it took is no longer there for later rules.
Identifiers that no rule took are reported as unmatched.

The sentences are found in one pass over Arrow batches; a rule is a replacement in the sequence by DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier, as they stand in the licences (fixed values).
SENTENCES: dict[str, list[str]] = {
    "ccByNc4": ["Licensed under CC BY-NC 4.0.",
                "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "ccBy4": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "ccBySa4": ["Licensed under CC BY-SA 4.0.",
                "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0."],
    "apacheShort": ["Licensed under the Apache License, Version 2.0."],
    "apacheHead": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apacheUse": ["you may not use this file except in compliance with the License."],
    "apacheCopy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apacheAsIs": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an '
                   '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apacheSee": ["See the License for the specific language governing permissions and limitations under the License."],
    "mitShort": ["Released under the MIT License.", "Licensed under the MIT License."],
    "mitGrant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
                 'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
                 'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the '
                 'Software is furnished to do so, subject to the following conditions:'],
    "mitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
                  "Software."],
    "mitAsIs": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
                'WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mitLiable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
                  "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
                  "DEALINGS IN THE SOFTWARE."],
    "bsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met:"],
    "bsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer."],
    "bsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsdName": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                "derived from this software without specific prior written permission."],
    "iscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                 "provided that the above copyright notice and this permission notice appear in all copies."],
    "gpl3Short": ["This work is licensed under the GNU General Public License, version 3."],
    "gplFree": ["This program is free software:", "This program is free software;"],
    "gpl3Later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                  "Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2Later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                  "Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gplHope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gplImplied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gplDetails": ["See the GNU General Public License for more details."],
    "mpl2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "allRights": ["All rights reserved."],
}
#: Licence and its ordered sentence identifiers (fixed values); longer sequences are tried first.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apacheHead", "apacheUse", "apacheCopy", "apacheAsIs", "apacheSee"]),
    ("GPL-3.0-or-later", ["gplFree", "gpl3Later", "gplHope", "gplImplied", "gplDetails"]),
    ("GPL-2.0-or-later", ["gplFree", "gpl2Later", "gplHope", "gplImplied", "gplDetails"]),
    ("MIT", ["mitGrant", "mitNotice", "mitAsIs", "mitLiable"]),
    ("BSD-3-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdName"]),
    ("BSD-2-Clause", ["bsdGrant", "bsdSource", "bsdBinary"]),
    ("GPL-3.0-or-later", ["gplFree", "gpl3Later"]),
    ("GPL-2.0-or-later", ["gplFree", "gpl2Later"]),
    ("Apache-2.0", ["apacheHead", "apacheUse"]),
    ("MIT", ["mitGrant", "mitNotice"]),
    ("CC-BY-NC-4.0", ["ccByNc4"]), ("CC-BY-4.0", ["ccBy4"]), ("CC-BY-SA-4.0", ["ccBySa4"]), ("CC0-1.0", ["cc0"]),
    ("Apache-2.0", ["apacheShort"]), ("MIT", ["mitShort"]), ("ISC", ["iscGrant"]), ("GPL-3.0-only", ["gpl3Short"]),
    ("MPL-2.0", ["mpl2"]), ("Unlicense", ["unlicense"]), ("LicenseRef-all-rights-reserved", ["allRights"]),
]
BREAK = r"[\r\n]+|[.;:][ \t]+"
NOISE = "[^a-z0-9]+"
LINE, STOP = re.compile(r"[\r\n]+"), re.compile(r"[.;:](?:[ \t]+|\Z)")
LEADER = re.compile("[^a-z0-9]*")


@dataclass(frozen=True)
class Rulebook:
    sentences: dict[str, list[str]]
    rules: list[tuple[str, list[str]]]

    def known(self) -> dict[str, str]:
        """Normalised sentence to identifier. A sentence that the splitter would cut is known by its parts."""
        out: dict[str, str] = {}
        for name, forms in self.sentences.items():
            for form in forms:
                parts = [x for x in (re.sub(NOISE, " ", p.lower()).strip(" ") for p in re.split(BREAK, form)) if x]
                for i, p in enumerate(parts):
                    out.setdefault(p, name if i == len(parts) - 1 else f"{name}_{i + 1}")
        return out

    def sequences(self) -> list[tuple[str, str]]:
        """(licence, "|id|id|...") from the longest rule to the shortest; identifiers of sentences known by parts come in parts."""
        parts = {n: len([p for p in re.split(BREAK, forms[0]) if re.sub(NOISE, "", p.lower())]) for n, forms in self.sentences.items()}
        named = [(lic, [x for i in ids for x in [*(f"{i}_{k + 1}" for k in range(parts[i] - 1)), i]]) for lic, ids in self.rules]
        return [(lic, "".join(f"<{i}>" for i in ids)) for lic, ids in sorted(named, key=lambda r: -len(r[1]))]


DEFAULT = Rulebook(SENTENCES, RULES)


class Finder:
    """Identifiers of the known sentences of a text, in order."""

    def __init__(self, known: dict[str, str]):
        self.known = known
        self.begins = {s[:m.start()] for s in known for m in re.finditer(" ", s)}  # what a longer sentence may begin with
        self.noise = re.compile(NOISE)

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """(normalised piece, whether only line ends part it from the next)."""
        out: list[tuple[str, bool]] = []
        for line in LINE.split(text.lower()):
            parts = STOP.split(line[LEADER.match(line).end():])
            for k, part in enumerate(parts):
                plain = self.noise.sub(" ", part).strip(" ")
                if plain:
                    out.append((plain, k == len(parts) - 1))
                elif out and k < len(parts) - 1:
                    out[-1] = (out[-1][0], False)
        return out

    def ids(self, text: str) -> list[str]:
        pieces, out, i = self.pieces(text), [], 0
        while i < len(pieces):
            run, joined = pieces[i]
            j, hit, after = i, self.known.get(run), i + 1
            while joined and run in self.begins and j + 1 < len(pieces):
                j += 1
                run, joined = f"{run} {pieces[j][0]}", pieces[j][1]
                if run in self.known:
                    hit, after = self.known[run], j + 1
            if hit:
                out.append(hit)
            i = after
        return out


def scan(docs: DataFrame, book: Rulebook = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_sentences (known ones), sequence ("<id><id>..."), licences (" AND "-joined names of the
    rules that matched, each once, in alphabetical order), unmatched (identifiers no rule took). Null or empty text: 0 and "".
    """
    finder = Finder(book.known())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [finder.ids(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()),
                                              pa.array(["".join(f"<{i}>" for i in x) for x in ids], pa.string())],
                                             ["doc_id", "n_sentences", "sequence"])

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, n_sentences long, sequence string")
    return matched(df, book)


def matched(df: DataFrame, book: Rulebook) -> DataFrame:
    """Applies the rules in order; each takes its places out of what is left of the sequence."""
    rules = F.array(*[F.struct(F.lit(lic).alias("lic"), F.lit(seq).alias("seq")) for lic, seq in book.sequences()])

    def step(acc: Column, rule: Column) -> Column:
        hit = acc["rest"].contains(rule["seq"])
        return F.struct(F.when(hit, F.replace(acc["rest"], rule["seq"], F.lit("|"))).otherwise(acc["rest"]).alias("rest"),
                        F.when(hit, F.array_append(acc["found"], rule["lic"])).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("found"))
    done = df.withColumn("m", F.when(F.col("sequence") == "", start).otherwise(F.aggregate(rules, start, step)))
    return done.select("doc_id", "n_sentences", "sequence", F.array_join(F.array_sort(F.array_distinct("m.found")), " AND ").alias("licences"),
                       F.replace("m.rest", F.lit("|"), F.lit("")).alias("unmatched"))


def scan_sql(book: Rulebook = DEFAULT) -> str:
    """The same in DuckDB's SQL, over table documents."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in book.known().items())
    steps, last = [], "s0"
    for i, (lic, seq) in enumerate(book.sequences(), 1):
        steps.append(f"s{i} AS (SELECT doc_id, n_sentences, sequence, CASE WHEN contains(rest, {q(seq)}) THEN list_append(found, {q(lic)}) "
                     f"ELSE found END AS found, replace(rest, {q(seq)}, '|') AS rest FROM {last})")
        last = f"s{i}"
    return f"""WITH known(s, id) AS (VALUES {known}),
parts AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(coalesce(text, ''), '[\r\n]+|[.;:][ \t]+') AS p FROM documents),
each_ AS (SELECT r, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM parts),
ids AS (SELECT r, k, id FROM (SELECT r, k, trim(regexp_replace(lower(s), '{NOISE}', ' ', 'g')) AS n FROM each_) JOIN known ON n = s),
seqs AS (SELECT r, count(*) AS n, string_agg('<' || id || '>', '' ORDER BY k) AS sequence FROM ids GROUP BY r),
s0 AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(sequence, '') AS sequence, CAST([] AS VARCHAR[]) AS found,
  coalesce(sequence, '') AS rest FROM parts LEFT JOIN seqs USING (r)),
{', '.join(steps)}
SELECT doc_id, n_sentences, sequence, array_to_string(list_sort(list_distinct(found)), ' AND ') AS licences,
  replace(rest, '|', '') AS unmatched FROM {last}"""
