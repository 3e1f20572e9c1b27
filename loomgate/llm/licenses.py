"""Licence recognition by sentence rules.

A text is cut into pieces at marks and line ends, each is normalised (lower case, letters and digits only); a piece,
or several in a row that a known licence sentence runs over (a wrapped line, a colon or `v.` inside it), is mapped to
that sentence's identifier, the longest from where it starts. The identifiers of a text, in order, with a mark where more than
MAX_GAP other pieces lie between two, are matched against rules: a rule is the sequence of
identifiers that a licence's text or notice has. Rules are ordered, and a rule that
holds sets aside those it names as part of it. Only built-in functions, in one pass over the
rows, without a shuffle.

Defined results: null and empty texts, and texts without a known sentence, give no row; a licence
is reported once for each row of the table, however often it stands there; a null identifier stays null; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening sentences of public licence texts and notices, normalised.
SENTENCES = (
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "this is free and unencumbered software released into the public domain",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "spdx license identifier gpl 3 0 only",
    "spdx license identifier gpl 3 0 or later",
    "spdx license identifier bsd 3 clause",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "see the gnu affero general public license for more details",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu lesser general public license for more details",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "this software is provided as is without any express or implied warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "this notice may not be removed or altered from any source distribution",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "spdx license identifier bsd 2 clause",
    "spdx license identifier mpl 2 0",
    "spdx license identifier isc",
    "spdx license identifier agpl 3 0 or later",
    "spdx license identifier lgpl 2 1 or later",
    "spdx license identifier unlicense",
)
#: Rules in their order: name, licence, places of the sentences in SENTENCES (from 1), rules that are part of it.
RULES = (
    ("mit_text", "MIT", (3, 4, 5), ("mit_grant",)),
    ("mit_grant", "MIT", (3, 4), ()),
    ("mit_notice", "MIT", (1,), ()),
    ("mit_notice_2", "MIT", (2,), ()),
    ("apache_header", "Apache-2.0", (7, 8, 9), ("apache_header_short",)),
    ("apache_header_short", "Apache-2.0", (7, 8), ()),
    ("apache_notice", "Apache-2.0", (6,), ()),
    ("gpl3_header", "GPL-3.0-or-later", (11, 13, 14), ("gpl3_grant",)),
    ("gpl3_grant", "GPL-3.0-or-later", (11,), ()),
    ("gpl3_notice", "GPL-3.0", (10,), ()),
    ("gpl2_header", "GPL-2.0-or-later", (12, 13, 14), ("gpl2_grant",)),
    ("gpl2_grant", "GPL-2.0-or-later", (12,), ()),
    ("bsd3_text", "BSD-3-Clause", (15, 16, 17, 18), ("bsd2_text",)),
    ("bsd2_text", "BSD-2-Clause", (15, 16, 17), ()),
    ("cc_by_nc_notice", "CC-BY-NC-4.0", (19,), ()),
    ("cc_by_notice", "CC-BY-4.0", (20,), ()),
    ("cc_by_sa_notice", "CC-BY-SA-4.0", (21,), ()),
    ("cc_by_deed", "CC-BY-4.0", (22,), ()),
    ("cc_by_sa_deed", "CC-BY-SA-4.0", (23,), ()),
    ("cc_by_nc_deed", "CC-BY-NC-4.0", (24,), ()),
    ("unlicense_text", "Unlicense", (25,), ()),
    ("mpl2_header", "MPL-2.0", (26,), ()),
    ("isc_text", "ISC", (27, 5), ("isc_grant",)),
    ("isc_grant", "ISC", (27,), ()),
    ("spdx_mit", "MIT", (28,), ()),
    ("spdx_apache", "Apache-2.0", (29,), ()),
    ("spdx_gpl3", "GPL-3.0", (30,), ()),
    ("spdx_gpl3_later", "GPL-3.0-or-later", (31,), ()),
    ("spdx_bsd3", "BSD-3-Clause", (32,), ()),
    ("agpl3_header", "AGPL-3.0-or-later", (33, 13, 34), ("agpl3_grant",)),
    ("agpl3_grant", "AGPL-3.0-or-later", (33,), ()),
    ("lgpl21_header", "LGPL-2.1-or-later", (35, 37, 38), ("lgpl21_grant",)),
    ("lgpl21_grant", "LGPL-2.1-or-later", (35,), ()),
    ("lgpl3_header", "LGPL-3.0-or-later", (36, 13, 38), ("lgpl3_grant",)),
    ("lgpl3_grant", "LGPL-3.0-or-later", (36,), ()),
    ("epl2_header", "EPL-2.0", (39,), ()),
    ("epl2_header_2", "EPL-2.0", (40,), ()),
    ("bsl1_text", "BSL-1.0", (41,), ()),
    ("zlib_text", "Zlib", (42, 43, 44, 45), ("zlib_grant",)),
    ("zlib_grant", "Zlib", (44, 45), ()),
    ("bsd3_whole", "BSD-3-Clause", (15, 16, 17, 18, 48), ("bsd3_text", "bsd2_text", "bsd2_whole")),
    ("bsd2_whole", "BSD-2-Clause", (15, 16, 17, 48), ("bsd2_text",)),
    ("isc_whole", "ISC", (27, 49), ("isc_grant",)),
    ("apache_text", "Apache-2.0", (50,), ()),
    ("spdx_bsd2", "BSD-2-Clause", (51,), ()),
    ("spdx_mpl2", "MPL-2.0", (52,), ()),
    ("spdx_isc", "ISC", (53,), ()),
    ("spdx_agpl3_later", "AGPL-3.0-or-later", (54,), ()),
    ("spdx_lgpl21_later", "LGPL-2.1-or-later", (55,), ()),
    ("spdx_unlicense", "Unlicense", (56,), ()),
)
#: Ends of sentences: a mark before white space or the end, a line end, a colon or a dash before one.
BOUNDARY = r"[.!?:;]+(\s+|$)|\n+"
MAX_GAP = 3
#: What a piece may hold if a known sentence starts with it and runs on; pieces a sentence may run over, empty ones between.
STARTS = sorted({" ".join(s.split()[:n]) for s in SENTENCES for n in range(1, len(s.split()))})
LONGEST = 2 * max(len(s.split()) for s in SENTENCES)


def rule_pattern(places: tuple[int, ...]) -> str:
    """A rule over the text form of identifiers, `3 4 | 5 `: in order, others may lie between, no gap mark."""
    return r"(^| )" + r" ([0-9]+ )*?".join(map(str, places)) + " "


def _normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def licence_sentences(text: Column) -> Column:
    """array<struct<s, i, e>>: identifier and numbers of the first and last piece of every known sentence of text, in order."""
    known = F.array(*map(F.lit, SENTENCES))

    def placed(pieces: Column) -> Column:
        def joined(i: Column, n: Column) -> Column:
            return F.array_join(F.filter(F.slice(pieces, i + 1, n), lambda x: x != ""), " ")

        def longest(i: Column) -> Column:
            """Of the pieces from i on, how many make a known sentence; at most, and without empty ones behind it."""
            widths = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size(pieces) - i))
            return F.array_max(F.filter(widths, lambda n: (F.get(pieces, i + n - 1) != "") & (F.array_position(known, joined(i, n)) > 0)))

        def at(piece: Column, i: Column) -> Column:
            n = F.when(piece.isin(STARTS), longest(i)).otherwise(1)
            return F.struct(F.when(piece.isin(STARTS), F.array_position(known, joined(i, n))).otherwise(F.array_position(known, piece)).alias("s"), i.alias("i"), (i + n - 1).alias("e"))

        return F.filter(F.transform(pieces, at), lambda x: x["s"] > 0)

    # through one-entry arrays, so that the pieces are made once, not for each piece
    cut = F.split(F.coalesce(text, F.lit("")), BOUNDARY)
    return F.get(F.transform(F.array(F.transform(cut, _normalised)), placed), 0)


#: What a text with a known sentence holds, in lower case: the first words of one, behind none of its letters and digits.
HEADS = "(?:^|[^a-z0-9])(?:" + "|".join(sorted({"[^a-z0-9]+".join(s.split()[:3]) for s in SENTENCES})) + ")"


def sequence_text(found: Column) -> Column:
    """Identifiers with a space after each, and `| ` before one that stands too far from the last."""

    def shown(x: Column, k: Column) -> Column:
        far = (k > 0) & (x["i"] - F.get(found, k - 1)["e"] > MAX_GAP + 1)
        return F.concat(F.when(far, "| ").otherwise(""), x["s"].cast("string"), F.lit(" "))

    return F.array_join(F.transform(found, shown), "")


def _is(place: int):
    return lambda x: x["s"] == place


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs and rule that holds: doc_id, rule, licence, rule_order, sentences, first_sentence."""
    # out of a generator, below which no filter goes: else the sentences would be looked for once to filter and once more
    hits = docs.where(F.lower(F.col(text_col)).rlike(HEADS)).select(F.col(id_col).alias("doc_id"), F.explode(F.array(licence_sentences(F.col(text_col)))).alias("found")).where(F.size("found") > 0)
    hits = hits.withColumn("sentences", sequence_text(F.col("found")))
    holds = {name: F.col("sentences").rlike(rule_pattern(places)) for name, _, places, _ in RULES}
    part_of = {name: [a for a, _, _, parts in RULES if name in parts] for name, *_ in RULES}
    rows = []
    for order, (name, licence, places, _) in enumerate(RULES, 1):
        alone = holds[name]
        for larger in part_of[name]:
            alone = alone & ~holds[larger]
        first = F.get(F.filter("found", _is(places[0])), 0)["i"]
        rows.append(F.when(alone, F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence"), F.lit(order).alias("rule_order"), first.alias("first_sentence"))))
    each = hits.select("doc_id", "sentences", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r"))
    return each.select("doc_id", "r.rule", "r.licence", "r.rule_order", F.trim("sentences").alias("sentences"), F.col("r.first_sentence").cast("int").alias("first_sentence"))


def oracle() -> str:
    """The same in DuckDB SQL, but for sentences that run over several pieces."""
    known = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"
    parts = {name: [a for a, _, _, p in RULES if name in p] for name, *_ in RULES}
    pattern = {name: rule_pattern(places) for name, _, places, _ in RULES}
    arms = []
    for order, (name, licence, places, _) in enumerate(RULES, 1):
        holds = " AND ".join([f"regexp_matches(sentences, '{pattern[name]}')", *(f"NOT regexp_matches(sentences, '{pattern[x]}')" for x in parts[name])])
        arms.append(f"SELECT doc_id, '{name}' AS rule, '{licence}' AS licence, {order} AS rule_order, trim(sentences) AS sentences, list_filter(found, lambda x: x.s = {places[0]})[1].i AS first_sentence FROM hits WHERE {holds}")
    return rf"""
WITH cut AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{BOUNDARY}') AS parts FROM documents),
seen AS (SELECT doc_id, list_filter(list_transform(parts, lambda p, k: {{'s': list_position({known}, trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'))), 'i': (k - 1)::INT}}), lambda x: x.s > 0) AS found FROM cut),
hits AS (SELECT *, array_to_string(list_transform(found, lambda x, k: CASE WHEN k > 1 AND x.i - found[k - 1].i > {MAX_GAP + 1} THEN '| ' ELSE '' END || x.s || ' '), '') AS sentences FROM seen WHERE len(found) > 0)
{" UNION ALL ".join(arms)}"""
