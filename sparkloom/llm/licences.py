"""Licence scan by sentence rules, with built-in functions only.

A text's sentences are normalised (lower case, letters and digits only) and looked up among known licence sentences; the
sequence of the identifiers found is matched against rules, each an ordered run of identifiers. Sentences are taken from
lines as they stand and from the text with its lines joined, so that wrapped licence texts and single lines both count, and,
for the rules alone, from paragraphs with their lines joined, as headings and copyright lines seldom end like sentences. A
paragraph ends at a line without letters and digits and on both sides of a copyright line with a year or sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, documents
from .rules import let

# Sentences of public licence texts, normalised.
SENTENCES = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "released under the mit license",
    "licensed under the mit license",
    "this project is licensed under the mit license",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "this work is licensed under the gnu general public license version 3",
    "this work is licensed under the gnu general public license version 2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "licensed under cc0 1 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "this is free and unencumbered software released into the public domain",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all rights reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "you may obtain a copy of the license at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache license version 2 0 january 2004 http www apache org licenses",
    "apache license version 2 0 january 2004 https www apache org licenses",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mozilla public license version 2 0",
    "gnu general public license version 3 29 june 2007",
    "gnu general public license version 2 june 1991",
    "gnu lesser general public license version 3 29 june 2007",
    "gnu lesser general public license version 2 1 february 1999",
    "gnu affero general public license version 3 19 november 2007",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "see the gnu affero general public license for more details",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu lesser general public license for more details",
    "eclipse public license v 2 0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "the artistic license 2 0",
    "boost software license version 1 0 august 17th 2003",
)
# A rule is a licence and the numbers of its sentences in order, counted from 0 in SENTENCES.
RULES = (
    ("MIT", (0, 1, 2)),
    ("MIT", (3,)),
    ("MIT", (4,)),
    ("MIT", (5,)),
    ("Apache-2.0", (6,)),
    ("Apache-2.0", (7, 8, 9)),
    ("GPL-3.0-only", (10,)),
    ("GPL-2.0-only", (11,)),
    ("GPL-3.0-or-later", (12, 14, 15)),
    ("GPL-2.0-or-later", (13, 14, 15)),
    ("CC-BY-NC-4.0", (16,)),
    ("CC-BY-4.0", (17,)),
    ("CC-BY-SA-4.0", (18,)),
    ("CC0-1.0", (19,)),
    ("CC-BY-4.0", (20,)),
    ("CC-BY-SA-4.0", (21,)),
    ("CC-BY-NC-4.0", (22,)),
    ("BSD-2-Clause", (23, 24, 25)),
    ("BSD-3-Clause", (23, 24, 25, 26)),
    ("ISC", (27, 1)),
    ("Unlicense", (28,)),
    ("MPL-2.0", (29,)),
    ("proprietary", (30,)),
    ("MIT", (31, 32, 1, 2)),
    ("Apache-2.0", (7, 33, 34, 9)),
    ("Apache-2.0", (35,)),
    ("Apache-2.0", (36,)),
    ("BSD-2-Clause", (37, 24, 25)),
    ("BSD-3-Clause", (37, 24, 25, 26)),
    ("ISC", (27, 38)),
    ("MPL-2.0", (39,)),
    ("GPL-3.0-only", (40,)),
    ("GPL-2.0-only", (41,)),
    ("LGPL-3.0-only", (42,)),
    ("LGPL-2.1-only", (43,)),
    ("AGPL-3.0-only", (44,)),
    ("AGPL-3.0-or-later", (45, 14, 46)),
    ("LGPL-2.1-or-later", (47, 48, 49)),
    ("EPL-2.0", (50,)),
    ("EPL-2.0", (51,)),
    ("CC0-1.0", (52,)),
    ("Artistic-2.0", (53,)),
    ("BSL-1.0", (54,)),
)
#: Counts only where no other licence is found, as most licences' copyright lines say so too.
UNSAID = "proprietary"
#: A text without any of these has no known sentence. Each lies in one word, so that it doesn't matter what stands between words.
ANCHORS = "licen|copyright|warrant|redistribut|permission|unencumbered|reserved"
SENTENCE_END = r"[.!?]+([ \t\r\n]+|\z)"
#: In lower case: a copyright line, and what stands between paragraphs. BREAK is put between paragraphs and sentences.
COPYRIGHT_LINE = r"(^|\n)([^a-z0-9\n]*copyright[ \t]+(?:\(c\)|\xa9|[0-9])[^\n]*)"
EMPTY_LINE, BREAK = r"\n[^a-z0-9\n]*\n", "\x01"


def _identifiers(sentences: Column) -> Column:
    """The numbers of the known sentences, in order."""
    known = F.create_map(*(F.lit(x) for i, s in enumerate(SENTENCES) for x in (s, i)))
    number = lambda s: F.element_at(known, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.array_compact(F.transform(sentences, number))


def _run(identifiers: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(identifiers, " "), F.lit(" "))


def _as_run(numbers: tuple[int, ...]) -> str:
    return f" {' '.join(map(str, numbers))} "


def _longer(run: str) -> list[str]:
    """Rules whose run goes on where this one ends or begins: where they match, this one doesn't count."""
    return sorted({_as_run(n) for _, n in RULES if run in _as_run(n)} - {run})


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, licences) of each row of ``docs``: known licence sentences, lines and joined lines counted apart, and the licences found.

    Whole texts are read, however long; one without an anchor costs one search. ``licences`` are identifiers in code-point order with commas between them, each once; empty if there is none. Of rules that lie
    in each other the longest counts, and reserved rights alone only where there is no other licence. A null or empty text has none. Repeated rows and null ids are scanned like others. An empty table gives no row. Other columns are
    ignored.
    """
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    ends = lambda t: F.split(F.regexp_replace(t, SENTENCE_END, "\n"), "\n", -1)
    apart = F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, "\n\n$2\n"), EMPTY_LINE, BREAK)
    lines, joined, paragraphs = ends(text), ends(F.translate(text, "\n", " ")), ends(F.translate(apart, "\n" + BREAK, " \n"))
    likely = text.rlike(ANCHORS)
    none = F.array().cast("array<int>")

    def found(runs: Column) -> Column:
        rules: dict[str, list[str]] = {}
        for licence, numbers in RULES:
            rules.setdefault(licence, []).append(_as_run(numbers))

        def hit(run: str) -> Column:
            def within(r: Column) -> Column:
                for longer in _longer(run):
                    r = F.replace(r, F.lit(longer), F.lit(" # "))
                return F.contains(r, F.lit(run))

            return F.exists(runs, within)

        names = []
        for licence, texts in rules.items():
            match = hit(texts[0])
            for t in texts[1:]:
                match = match | hit(t)
            names.append(F.when(match, F.lit(licence)))
        every = F.array_sort(F.array_compact(F.array(*names)))
        return let(every, lambda x: F.array_join(F.when(F.size(x) > 1, F.array_remove(x, UNSAID)).otherwise(x), ","))

    forms = F.when(likely, F.array(_identifiers(lines), _identifiers(joined), _identifiers(paragraphs))).otherwise(F.array(none, none, none))
    size = lambda forms, i: F.size(F.get(forms, F.lit(i)))
    rows = docs.select("doc_id", let(forms, lambda f: F.struct((size(f, 0) + size(f, 1)).alias("n"), F.transform(f, _run).alias("runs"), (F.size(F.flatten(f)) > 0).alias("some"))).alias("s"))
    licences = F.when(F.col("s.some"), let(F.col("s.runs"), found)).otherwise(F.lit(""))
    return rows.select("doc_id", F.col("s.n").cast("long").alias("n_sentences"), licences.alias("licences"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


def _oracle() -> str:
    known = ", ".join(f"('{s}', {i})" for i, s in enumerate(SENTENCES))
    values = []
    for licence, numbers in RULES:
        longer = _longer(_as_run(numbers))
        if len(longer) > 1:
            raise ValueError("the SQL knows one longer rule for each")
        values.append(f"('{licence}', '{_as_run(numbers)}', '{longer[0] if longer else '-'}')")
    rules = ", ".join(values)
    sentence_end, new_line, apart = SENTENCE_END, "chr(10)", "chr(1)"
    return f"""
WITH known(sentence, number) AS (VALUES {known}), rules(licence, run, longer) AS (VALUES {rules}),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lowered AS (SELECT r, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM numbered),
forms AS (
    SELECT r, 0 AS form, t FROM lowered UNION ALL SELECT r, 1 AS form, translate(t, chr(10), ' ') AS t FROM lowered
    UNION ALL SELECT r, 2 AS form, translate(
        regexp_replace(regexp_replace(t, '{COPYRIGHT_LINE}', {new_line} || {new_line} || '\\2' || {new_line}, 'g'), '{EMPTY_LINE}', {apart}, 'g'),
        {new_line} || {apart}, ' ' || {new_line}
    ) AS t FROM lowered
), cut AS (
    SELECT r, form, string_split(regexp_replace(t, '{sentence_end}', chr(10), 'g'), chr(10)) AS parts FROM forms
), sentences AS (
    SELECT r, form, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM cut
), hits AS (
    SELECT s.r, s.form, s.place, k.number
    FROM sentences AS s JOIN known AS k ON trim(regexp_replace(s.part, '[^a-z0-9]+', ' ', 'g')) = k.sentence
), runs AS (
    SELECT r, form, ' ' || string_agg(CAST(number AS VARCHAR), ' ' ORDER BY place) || ' ' AS run, count(*) AS n FROM hits GROUP BY r, form
), counted AS (
    SELECT r, sum(n) AS n FROM runs WHERE form < 2 GROUP BY r
), matched AS (
    SELECT DISTINCT runs.r, rules.licence FROM runs JOIN rules ON contains(replace(runs.run, rules.longer, ' # '), rules.run)
), named AS (
    SELECT m.r, string_agg(m.licence, ',' ORDER BY m.licence) AS licences FROM matched AS m JOIN (SELECT r, count(*) AS n FROM matched GROUP BY r) AS x ON x.r = m.r
    WHERE x.n = 1 OR m.licence <> '{UNSAID}' GROUP BY m.r
)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_sentences, coalesce(n.licences, '') AS licences
FROM numbered AS d LEFT JOIN counted AS c ON d.r = c.r LEFT JOIN named AS n ON d.r = n.r
"""


ORACLE_LICENCES = _oracle()
