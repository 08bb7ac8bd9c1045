"""Licence scans by sentence rules: sentences to identifiers, then sequences of identifiers to licences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Known licence sentences, normalised: lower case, runs of other characters than letters and digits as one blank (fixed values).
SENTENCES = {
    "mit_name": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "mit license", "the mit license", "the mit license mit", "licensed under mit", "distributed under the mit license", "license mit",),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement",),
    "gpl2_only": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 only as published by the free software foundation",),
    "gpl3_only": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",),
    "lgpl21_only": ("this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 2 1 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version 2 1 as published by the free software foundation",),
    "agpl3_only": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license version 3 as published by the free software foundation",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "apache_name": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "apache license version 2 0", "released under the apache license version 2 0",),
    "apache_comply": ("you may not use this file except in compliance with the license",),
    "apache_copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0",),
    "gpl3_name": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3",),
    "gpl2_name": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2",),
    "gpl_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl2_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl_hope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl_received": ("you should have received a copy of the gnu general public license along with this program", "you should have received a copy of the gnu lesser general public license along with this library", "you should have received a copy of the gnu affero general public license along with this program",),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd_name": ("licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "bsd 3 clause license",),
    "mpl_name": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0",),
    "cc_by_nc_name": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",),
    "cc_by_name": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "attribution 4 0 international",),
    "cc_by_sa_name": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0 international",),
    "cc0_name": ("this work is dedicated to the public domain under cc0 1 0", "licensed under cc0 1 0", "cc0 1 0 universal",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "mit_liable": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc_name": ("isc license", "licensed under the isc license", "released under the isc license",),
    "isc_as_is": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "apache_text": ("apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004", "version 2 0 january 2004",),
    "apache_asis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache_limits": ("see the license for the specific language governing permissions and limitations under the license",),
    "gpl3_text": ("gnu general public license version 3 29 june 2007",),
    "gpl2_text": ("gnu general public license version 2 june 1991",),
    "lgpl21_free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "lgpl3_free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "agpl3_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "lgpl21_name": ("gnu lesser general public license version 2 1 february 1999", "licensed under the gnu lesser general public license version 2 1",),
    "lgpl3_name": ("gnu lesser general public license version 3 29 june 2007", "licensed under the gnu lesser general public license version 3",),
    "agpl3_name": ("gnu affero general public license version 3 19 november 2007", "licensed under the gnu affero general public license version 3",),
    "gpl_details": ("see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details",),
    "bsd_as_is": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "bsd2_name": ("licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "bsd 2 clause license",),
    "mpl_copy": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",),
    "epl_name": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0", "licensed under the eclipse public license version 2 0", "eclipse public license v 2 0",),
    "zlib_as_is": ("this software is provided as is without any express or implied warranty",),
    "zlib_liable": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "zlib_name": ("licensed under the zlib license", "zlib license",),
    "bsl_name": ("boost software license version 1 0", "boost software license version 1 0 august 17th 2003", "distributed under the boost software license version 1 0", "licensed under the boost software license version 1 0",),
    "bsl_grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "ofl_name": ("this font software is licensed under the sil open font license version 1 1", "sil open font license version 1 1 26 february 2007", "licensed under the sil open font license version 1 1",),
    "wtfpl": ("do what the fuck you want to public license version 2 december 2004",),
}
#: Ordered rules: the identifiers of a licence in their order; sentences that begin no rule may lie between. From left to
#: right, the first rule that fits at a place names a span, so longer rules of a family stand before the shorter.
RULES = (
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names",)),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary",)),
    ("BSD-3-Clause", ("bsd_name",)),
    ("BSD-2-Clause", ("bsd2_name",)),
    ("MIT", ("mit_name", "mit_grant", "mit_notice", "as_is", "mit_liable",)),
    ("MIT", ("mit_grant", "mit_notice", "as_is", "mit_liable",)),
    ("MIT", ("mit_grant", "mit_notice", "as_is",)),
    ("MIT", ("mit_grant", "mit_notice",)),
    ("MIT", ("mit_name",)),
    ("ISC", ("isc_name", "isc_grant", "isc_as_is",)),
    ("ISC", ("isc_grant", "isc_as_is",)),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_name",)),
    ("Apache-2.0", ("apache_name", "apache_comply", "apache_copy", "apache_asis", "apache_limits",)),
    ("Apache-2.0", ("apache_name", "apache_comply", "apache_copy",)),
    ("Apache-2.0", ("apache_text",)),
    ("Apache-2.0", ("apache_name",)),
    ("LGPL-3.0-or-later", ("lgpl3_free", "gpl_hope", "gpl_details", "gpl_received",)),
    ("LGPL-3.0-or-later", ("lgpl3_free",)),
    ("LGPL-2.1-or-later", ("lgpl21_free", "gpl_hope", "gpl_details", "gpl_received",)),
    ("LGPL-2.1-or-later", ("lgpl21_free",)),
    ("AGPL-3.0-or-later", ("agpl3_free", "gpl_hope", "gpl_details", "gpl_received",)),
    ("AGPL-3.0-or-later", ("agpl3_free",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_details", "gpl_received",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_received",)),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_details", "gpl_received",)),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_received",)),
    ("GPL-2.0-or-later", ("gpl2_free",)),
    ("GPL-2.0-only", ("gpl2_only", "gpl_hope", "gpl_details", "gpl_received",)),
    ("GPL-2.0-only", ("gpl2_only",)),
    ("GPL-3.0-only", ("gpl3_only", "gpl_hope", "gpl_details", "gpl_received",)),
    ("GPL-3.0-only", ("gpl3_only",)),
    ("LGPL-2.1-only", ("lgpl21_only",)),
    ("AGPL-3.0-only", ("agpl3_only",)),
    ("LGPL-3.0", ("lgpl3_name",)),
    ("LGPL-2.1", ("lgpl21_name",)),
    ("AGPL-3.0", ("agpl3_name",)),
    ("GPL-3.0", ("gpl3_text",)),
    ("GPL-2.0", ("gpl2_text",)),
    ("GPL-3.0", ("gpl3_name",)),
    ("GPL-2.0", ("gpl2_name",)),
    ("MPL-2.0", ("mpl_name", "mpl_copy",)),
    ("MPL-2.0", ("mpl_name",)),
    ("EPL-2.0", ("epl_name",)),
    ("Zlib", ("zlib_as_is", "zlib_liable", "zlib_grant",)),
    ("Zlib", ("zlib_grant",)),
    ("Zlib", ("zlib_name",)),
    ("BSL-1.0", ("bsl_name", "bsl_grant",)),
    ("BSL-1.0", ("bsl_grant",)),
    ("BSL-1.0", ("bsl_name",)),
    ("OFL-1.1", ("ofl_name",)),
    ("WTFPL", ("wtfpl",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_name",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_name",)),
    ("CC-BY-4.0", ("cc_by_name",)),
    ("CC0-1.0", ("cc0_name",)),
    ("Unlicense", ("unlicense",)),
)
#: Places of known sentences that hold names or come in other words, and the words that the table has there (fixed values).
SLOTS = (
    (r"^neither the names? of .+ nor the names? of (?:its |their |any |the |other )*contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"^the names? of .+ may not be used to endorse or promote products derived from this software without", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without"),
    (r"^this software is provided by .+ as is and any express or implied warranties", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    (r"^in no event shall .+ be liable for any claim damages or other liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    (r"^permission to use copy modify (?:and or|and|or) distribute this software( and its documentation)? for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (r"^the software is provided as is and .+ disclaims? all warranties", "the software is provided as is and the author disclaims all warranties"),
    (r"^(?:this|the) (?:library|software|file|package|module|code) is free software you (?:can|may) redistribute it and or modify it", "this program is free software you can redistribute it and or modify it"),
    (r"^.+ is free software you (?:can|may) redistribute it and or modify it under the terms of the gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
)
#: What a sentence with such a place has.
SLOTTED = r"^neither the name|^the names? of .+ may not be used|^this software is provided by|^in no event shall|^permission to use copy modify|^the software is provided as is and|is free software you "
#: Short forms whose full stop ends no sentence where a small letter follows.
SHORT = r"\b(Inc|INC|Ltd|LTD|Corp|CORP|Co|CO|GmbH|Dr|al|No)\.([ \t]+[a-z])"
#: Licences that are named by an SPDX tag: names joined by operators, up to the first word that is neither.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)"
#: Where a sentence ends inside a paragraph: before a blank after a full stop or mark, a closed bracket with semicolon, or the colon of a list.
SENTENCE_END = r"(?i)([.!?]|\);|conditions:|met:|following:|restrictions:)[ \t]+"
#: The first of the characters that stand for sentences while rules are matched.
FIRST = 0x3041
RARE = ("license", "licensed", "permission", "warranty", "copyright", "redistribution", "redistributions", "compliance", "cc0", "cc", "unencumbered", "mpl", "liable", "attribution", "neither")


def _anchor(sentences=SENTENCES) -> str:
    """A pattern that every text with a known sentence has: one word of each, chosen rare."""
    chosen = set()
    for text in (s for group in sentences.values() for s in group):
        have = set(text.split())
        chosen.add(next((w for w in RARE if w in have), max(sorted(have), key=len)))
    return "|".join(sorted(chosen))


def _clean(s):
    """A sentence as the table has it: small letters and digits, single blanks, names in their places replaced."""

    def slots(c):
        out = c
        for pattern, words in SLOTS:
            out = F.regexp_replace(out, pattern, words)
        return F.when(c.rlike(SLOTTED), out).otherwise(c)

    return let(F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")), slots)


def known_sentences(text, sentences=SENTENCES):
    """The identifiers of the known sentences in a text, in their order, as an array; null for null.

    Lines without a letter or digit end a paragraph. A line that is a known sentence stands for itself; the other
    lines of a paragraph are joined, whatever comment marks they begin with, and split into sentences.
    """
    ids = {s: name for name, group in sentences.items() for s in group}
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    lines = F.transform(F.split(text, r"\R"), lambda x: let(_clean(x), lambda c: F.when(c == "", "\n").when(c.isin(*ids), F.concat(F.lit("\n"), c, F.lit("\n"))).otherwise(F.regexp_replace(x, r"\A[^\p{L}\p{N}(]+", ""))))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), SHORT, "$1$2"), SENTENCE_END, "$1\n")
    found = F.transform(F.filter(F.transform(F.split(joined, "\n"), _clean), lambda s: s.isin(*ids)), lambda s: table[s])
    nothing = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(text.rlike(f"(?i){_anchor(sentences)}"), found).otherwise(nothing)


def _codes(sentences) -> dict[str, str]:
    return {name: chr(FIRST + i) for i, name in enumerate(sentences)}


def _patterns(sentences, rules) -> list[str]:
    """Each rule as a pattern over one character for each sentence."""
    code = _codes(sentences)
    gap = "[^" + "".join(sorted({code[rule[0]] for _, rule in rules})) + "]*?"
    return [gap.join(code[i] for i in rule) for _, rule in rules]


def licences_of(ids, sentences=SENTENCES, rules=RULES):
    """The licences whose rules the sequence holds, distinct, in the order of their spans."""
    code, patterns = _codes(sentences), _patterns(sentences, rules)
    table = F.create_map(*[F.lit(x) for pair in code.items() for x in pair])

    def named(span):
        out = F.lit(None).cast("string")
        for (name, _), pattern in reversed([*zip(rules, patterns)]):
            out = F.when(span.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
        return out

    spans = F.regexp_extract_all(F.array_join(F.transform(ids, lambda i: table[i]), ""), F.lit("|".join(patterns)), F.lit(0))
    return F.when(F.size(ids) > 0, F.array_distinct(F.transform(spans, named))).when(ids.isNotNull(), F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """``(doc_id, sentence_ids, licences, licence)`` for each row of ``docs``.

    Texts are split into paragraphs, lines and sentences; one counts if it is, normalised, a known one, whether or not
    the text is wrapped or commented. ``licences`` holds the licences whose ordered rule the identifiers hold, in the
    order of the text, then the expressions of SPDX tags as they are written; ``licence`` joins them by `` AND ``, with
    expressions of several names in brackets; null if there is none. Empty texts have empty arrays, null texts nulls.
    Rows are judged one by one, repeated ones too.
    """
    text = F.col(text_col)
    tags = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.regexp_replace(x, r"[ \t]+", " ")))
    tags = F.when(text.contains(":"), tags).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))
    found = docs.select(F.col(id_col).alias("doc_id"), known_sentences(text, sentences).alias("sentence_ids"), tags.alias("tags"))
    found = found.select("doc_id", "sentence_ids", F.array_union(licences_of(F.col("sentence_ids"), sentences, rules), "tags").alias("licences"))
    name = lambda x: F.when(x.contains(" "), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)
    return found.select("doc_id", "sentence_ids", "licences", F.when(F.size("licences") == 1, F.get("licences", 0)).when(F.size("licences") > 1, F.array_join(F.transform("licences", name), " AND ")).alias("licence"))


def oracle_sql(sentences=SENTENCES, rules=RULES) -> str:
    """The scan of ``documents`` in DuckDB: doc_id, the identifiers joined by blanks, and the licence."""
    code, patterns = _codes(sentences), _patterns(sentences, rules)
    ids = ", ".join(f"'{s}': '{name}'" for name, group in sentences.items() for s in group)
    codes = ", ".join(f"'{name}': '{c}'" for name, c in code.items())
    named = " ".join(f"WHEN regexp_full_match(x, '{p}') THEN '{name}'" for (name, _), p in zip(rules, patterns))
    plain = lambda x: rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

    def clean(x):
        out = plain(x)
        for pattern, words in SLOTS:
            out = f"regexp_replace({out}, '{pattern}', '{words}')"
        return f"CASE WHEN regexp_matches({plain(x)}, '{SLOTTED}') THEN {out} ELSE {plain(x)} END"

    return rf"""
WITH lines AS (SELECT doc_id, text, string_split_regex(text, '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM documents),
ids AS (SELECT MAP {{{ids}}} AS m, MAP {{{codes}}} AS c),
joined AS (SELECT doc_id, text, m, c, regexp_replace(regexp_replace(array_to_string(list_transform(ls, lambda x: CASE WHEN {clean('x')} = '' THEN chr(10) WHEN m[{clean('x')}] IS NOT NULL THEN chr(10) || {clean('x')} || chr(10) ELSE regexp_replace(x, '\A[^\p{{L}}\p{{N}}(]+', '') END), ' '), '{SHORT}', '\1\2', 'g'), '{SENTENCE_END}', '\1' || chr(10), 'g') AS line FROM lines, ids),
found AS (SELECT doc_id, text, c, list_filter(list_transform(string_split(line, chr(10)), lambda s: m[{clean('s')}]), lambda x: x IS NOT NULL) AS f FROM joined),
spans AS (SELECT doc_id, f, list_transform(regexp_extract_all(array_to_string(list_transform(f, lambda x: c[x]), ''), '{'|'.join(patterns)}'), lambda x: CASE {named} END) AS l, list_transform(regexp_extract_all(text, '{SPDX}', 1), lambda x: regexp_replace(x, '[ \t]+', ' ', 'g')) AS tags FROM found),
alls AS (SELECT doc_id, f, list_filter(l || tags, lambda x, i: list_position(l || tags, x) = i) AS names FROM spans)
SELECT doc_id, array_to_string(f, ' ') AS sentence_ids, CASE WHEN len(names) = 1 THEN names[1] WHEN len(names) > 1 THEN array_to_string(list_transform(names, lambda x: CASE WHEN contains(x, ' ') THEN '(' || x || ')' ELSE x END), ' AND ') END AS licence FROM alls
"""
