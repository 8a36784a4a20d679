"""Licences of documents, recognised by sequences of known sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import LOWER, UPPER, ascii_lower

#: Known sentences of licence notices.
SENTENCES = {
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
                 " General Public License as published by the Free Software Foundation, either version 3 of the License,"
                 " or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT'
                 " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial"
                  " portions of the Software.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
}
#: Rules in order of use; what a rule has matched is not seen by later ones.
RULES = [
    ("GPL-3.0-or-later", ["gpl-terms", "gpl-warranty", "gpl-fitness", "gpl-details", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-terms", "gpl-warranty", "gpl-fitness"]),
    ("GPL-3.0-or-later", ["gpl-terms"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("Apache-2.0", ["apache-head", "apache-use"]),
    ("Apache-2.0", ["apache-short"]),
    ("MIT", ["mit-notice", "mit-as-is"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
]

_FSF = "as published by the Free Software Foundation, "
_LATER = "of the License, or (at your option) any later version"
#: Further fixed values: sentences and decisive clauses of other licences, and rules that come after the others.
CLAUSES = {
    "gpl3-clause": f"GNU General Public License {_FSF}either version 3 {_LATER}",
    "gpl2-clause": f"GNU General Public License {_FSF}either version 2 {_LATER}",
    "lgpl3-clause": f"GNU Lesser General Public License {_FSF}either version 3 {_LATER}",
    "lgpl21-clause": f"GNU Lesser General Public License {_FSF}either version 2.1 {_LATER}",
    "agpl3-clause": f"GNU Affero General Public License {_FSF}either version 3 {_LATER}",
    "mpl2": "subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
           " granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
               " the following conditions are met",
    "bsd-names": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc0": "CC0 1.0 Universal",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
}
CLAUSE_RULES = [
    ("GPL-3.0-or-later", ["gpl3-clause"]), ("GPL-2.0-or-later", ["gpl2-clause"]), ("LGPL-3.0-or-later", ["lgpl3-clause"]),
    ("LGPL-2.1-or-later", ["lgpl21-clause"]), ("AGPL-3.0-or-later", ["agpl3-clause"]), ("MPL-2.0", ["mpl2"]), ("ISC", ["isc"]),
    ("BSD-3-Clause", ["bsd-use", "bsd-names"]), ("BSD-2-Clause", ["bsd-use"]), ("CC0-1.0", ["cc0"]), ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
]


def _plain(sentence: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


def _known() -> list[tuple[str, str]]:
    return [(_plain(s), f"<{name}>") for name, s in SENTENCES.items()]


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{x}>" for x in ids)


def sentences(text: Column) -> Column:
    """Normalised sentences: a-z and 0-9 in words with one space between, cut at line ends and after . ! ? ;"""
    lines = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"([.!?;])[ \t]+", "$1\n")
    plain = F.regexp_replace(lines, r"[^a-z0-9\n]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def _all_known() -> list[tuple[str, str]]:
    return _known() + [(_plain(s), f"<{name}>") for name, s in CLAUSES.items()]


def known_sentences(text: Column) -> Column:
    """The known sentences and clauses in the words of each paragraph, in order; a line end inside one is a space.

    The longest is taken where several begin. Each has one of four words, so that most texts are not searched.
    """
    low = ascii_lower(F.coalesce(text, F.lit("")))
    paragraphs = F.regexp_replace(F.translate(low, "|", " "), r"\n[^a-z0-9\n]*\n", "\n\n")
    plain = F.regexp_replace(F.regexp_replace(paragraphs, r"\n{2,}", "|"), r"[^a-z0-9|]+", " ")
    either = "|".join(sorted((s for s, _ in _all_known()), key=len, reverse=True))
    found = F.regexp_extract_all(plain, F.lit(rf"\b(?:{either})\b"), F.lit(0))
    return F.when(low.rlike("licen|warranty|software|cc0"), found).otherwise(F.array().cast("array<string>"))


def licences(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): sentences, known ones, their sequence and the licences it shows.

    A null text has none. A rule applies where its sentences follow each other
    among the known ones, other text between them or not; a licence is listed
    once, in the order of the rules. Nothing is shuffled and no row grows with others.
    """
    names = F.create_map(*[F.lit(x) for pair in _all_known() for x in pair])
    rows = docs.select("doc_id", sentences(F.col("text")).alias("s"), known_sentences(F.col("text")).alias("known"))
    rows = rows.withColumn("ids", F.transform("known", lambda s: F.try_element_at(names, s)))
    rows = rows.withColumn("left", F.concat_ws("", "ids"))
    found = []
    for k, (licence, ids) in enumerate(RULES + CLAUSE_RULES):
        rows = rows.withColumn(f"f{k}", F.when(F.contains(F.col("left"), F.lit(_sequence(ids))), F.lit(licence)))
        rows = rows.withColumn("left", F.replace(F.col("left"), F.lit(_sequence(ids)), F.lit("|")))
        found.append(F.col(f"f{k}"))
    listed = F.array_distinct(F.array_compact(F.array(*found)))
    return rows.select(
        "doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.size("ids").cast("bigint").alias("n_known"),
        F.concat_ws("", "ids").alias("sentence_ids"), F.concat_ws(",", listed).alias("licences"),
    )


def oracle(documents: str = "documents") -> str:
    """The same rows in SQL, where each known sentence stands on a line and none of `CLAUSES` occurs."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in _known()) + "}"
    left, found = "seq", []
    for licence, ids in RULES:
        found.append(f"CASE WHEN contains({left}, {quote(_sequence(ids))}) THEN {quote(licence)} END")
        left = f"replace({left}, {quote(_sequence(ids))}, '|')"
    return f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '([.!?;])[ \\t]+', '\\1' || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g') AS plain FROM {documents}),
s AS (SELECT doc_id, list_filter(list_transform(string_split(plain, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM t),
i AS (SELECT doc_id, s, list_filter(list_transform(s, lambda x: {names}[x]), lambda x: x IS NOT NULL) AS ids FROM s),
q AS (SELECT doc_id, s, ids, array_to_string(ids, '') AS seq FROM i),
f AS (SELECT doc_id, s, ids, seq, list_filter([{', '.join(found)}], lambda x: x IS NOT NULL) AS found FROM q)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(ids) AS BIGINT) AS n_known, seq AS sentence_ids,
  array_to_string(list_transform(list_sort(list_distinct(list_transform(found, lambda x: list_position(found, x)))),
    lambda k: found[k]), ',') AS licences
FROM f
"""
