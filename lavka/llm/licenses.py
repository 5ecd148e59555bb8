"""Licence recognition by sentences and ordered rules.

A text is cut into sentences at ``.``, ``!``, ``?``, ``;`` or ``:`` before white space and at blank
lines; the known sentences are pieces of the public texts cut in the same way. As a
sentence may follow other lines without a full stop and may be wrapped itself, its lines and its
ends of several lines are looked at as well, up to as many lines as a known sentence has words. Lower-cased
letters and digits with single spaces make the normal form, which is looked up among
the known sentences. The identifiers found, in order, are matched against
the rules; where several fit, the first one in the list wins.

Everything happens inside the row with built-in functions: no shuffle, and
repeated rows, null ids and hot sources make no difference. Null and empty
texts have no licence.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, in normal form.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-terms": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-either": "either version 2 of the license or at your option any later version",
    "gpl3-either": "either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "reserved": "all rights reserved",
}

# Licence by sequence of sentences, the more special ones first.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-condition", "mit-warranty"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-basis", "apache-terms"]),
    ("Apache-2.0", ["apache-header", "apache-comply"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-terms", "gpl3-either", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-terms", "gpl2-either", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-terms", "gpl3-either"]),
    ("GPL-2.0-or-later", ["gpl-terms", "gpl2-either"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    *(
        (name, [*before, "bsd-redistribution", "bsd-source", "bsd-binary", *more])
        for name, more in (
            ("BSD-3-Clause", ["bsd-endorse", "bsd-as-is"]),
            ("BSD-3-Clause", ["bsd-endorse"]),
            ("BSD-2-Clause", ["bsd-as-is"]),
            ("BSD-2-Clause", []),
        )
        for before in (["reserved"], [])
    ),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["spdx-mit"]),
    ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-3.0-only", ["spdx-gpl3"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-form"]),
    ("Unlicense", ["unlicense"]),
    ("proprietary", ["reserved"]),
]

#: Every known sentence has one of these; texts without any are not looked at.
TELLING = r"(?i)licen|permi|redistribut|warrant|rights|public|compliance|copyright"
SPACE = r"[ \t\n\f\r]+"
#: Where texts are cut: behind a mark before white space, and at lines without letters and digits. The
#: colon of an identifier line is none of these marks.
NO_CUT = r"(?i)(license-identifier):"
CUT = r"([.!?;:])" + SPACE
BLANK = r"\n[^A-Za-z0-9\n]*\n"


def longest(sentences: dict[str, str]) -> int:
    """The words of the longest sentence, hence the most lines that it can be wrapped over."""
    return max(len(s.split()) for s in sentences.values())


def candidates(sentence: Column, most: int) -> Column:
    """The lines of a sentence and its ends of several lines, with the first line's number."""
    lines = F.split(sentence, "\n")
    count = F.size(lines)
    single = F.transform(lines, lambda line, n: F.struct(n.cast("int").alias("line"), line.alias("part")))
    sizes = F.filter(F.sequence(F.lit(2), F.greatest(F.least(F.lit(most), count), F.lit(2))), lambda k: k <= count)
    ends = F.transform(
        sizes,
        lambda k: F.struct(
            (count - k).cast("int").alias("line"), F.array_join(F.slice(lines, count - k + 1, k), " ").alias("part")
        ),
    )
    return F.array_sort(F.concat(single, ends))


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in sentences.items()))
    mark = "\x01"
    text = F.regexp_replace(F.regexp_replace(text, NO_CUT, "$1"), BLANK, mark)
    parts = F.split(F.regexp_replace(text, CUT, "$1" + mark), mark)
    parts = F.filter(parts, lambda s: F.rlike(s, F.lit(TELLING)))
    most = longest(sentences)
    tried = F.flatten(F.transform(parts, lambda part: candidates(part, most)))

    def identified(tried_part: Column) -> Column:
        normal = F.trim(F.regexp_replace(F.lower(tried_part["part"]), "[^a-z0-9]+", " "))
        return F.try_element_at(known, normal)

    return F.filter(F.transform(tried, identified), lambda i: i.isNotNull())


def sequence_pattern(rules: list[tuple[str, list[str]]]) -> str:
    return "|".join("".join(f"{i} " for i in ids) for _, ids in rules)


def licences(
    docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None
) -> DataFrame:
    """Of each row with a licence, all columns and ``licence_no``, ``licence``, ``sentences``.

    One row per rule matched, numbered from 1 in the order of the text. Columns of these
    names that come with ``docs`` are replaced.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    docs = docs.drop("licence_no", "licence", "sentences")
    by_ids = {"".join(f"{i} " for i in ids): name for name, ids in reversed(rules)}
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in by_ids.items()))
    likely = docs.filter(F.rlike(F.col(text), F.lit(TELLING)))
    sequence = F.concat(F.array_join(sentence_ids(F.col(text), sentences), " "), F.lit(" "))
    matched = F.regexp_extract_all(sequence, F.lit("(" + sequence_pattern(rules) + ")"), F.lit(1))
    found = likely.select(*docs.columns, F.posexplode(matched).alias("licence_no", "sentences"))
    return found.select(
        *docs.columns,
        (F.col("licence_no") + 1).alias("licence_no"),
        F.element_at(names, F.col("sentences")).alias("licence"),
        F.trim("sentences").alias("sentences"),
    )


def oracle() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    named = {}
    for name, ids in RULES:
        named.setdefault("".join(f"{i} " for i in ids), name)
    names = ", ".join(f"('{k}', '{v}')" for k, v in named.items())
    return rf"""
WITH known(id, normal) AS (VALUES {known}), names(ids, licence) AS (VALUES {names}),
p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '{NO_CUT}', '\1', 'g'), '{BLANK}', chr(1), 'g'), '{CUT}', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
s AS (SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS i FROM p),
l AS (SELECT doc_id, i, string_split(sentence, chr(10)) AS lines FROM s WHERE regexp_matches(sentence, '{TELLING}')),
c AS (SELECT doc_id, i, unnest(range(len(lines))) AS line, unnest(lines) AS part FROM l
      UNION ALL SELECT doc_id, i, len(lines) - k, array_to_string(lines[len(lines) - k + 1:], ' ')
      FROM l, range(2, {longest(SENTENCES) + 1}) AS r(k) WHERE k <= len(lines)),
f AS (SELECT doc_id, i, line, part, id FROM c JOIN known
      ON normal = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))),
q AS (SELECT doc_id, string_agg(id, ' ' ORDER BY i, line, part) || ' ' AS ids FROM f GROUP BY doc_id),
m AS (SELECT doc_id, regexp_extract_all(ids, '({sequence_pattern(RULES)})', 1) AS found FROM q),
u AS (SELECT doc_id, unnest(found) AS ids, unnest(range(len(found))) AS n FROM m)
SELECT doc_id, (n + 1)::INT AS licence_no, licence, trim(ids) AS sentences FROM u JOIN names USING (ids)
"""
