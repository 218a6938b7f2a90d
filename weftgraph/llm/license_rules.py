"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, which are normalised (lower case, runs of other characters than a-z and 0-9 become one blank). Sentences known from
licences become identifiers, all others vanish. A rule is a sequence of identifiers; it holds where they stand in this order with no
other known sentence between. Texts are read twice: once each line break ends a sentence, once only blank lines do (licence
texts are wrapped); a rule may hold in either reading.

All is one narrow projection over whole texts. Every known sentence holds one of a few telling words, so a text without them is
looked through once and no more.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Known sentences by identifier, as normalised.
SENTENCES = {
    "mit-note": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"],
    "apache-note": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "spdx license identifier apache 2 0"],
    "gpl3-note": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"],
    "ccbync-note": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "spdx license identifier cc by nc 4 0"],
    "ccby-note": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "spdx license identifier cc by 4 0"],
    "cc0-note": ["spdx license identifier cc0 1 0", "licensed under cc0 1 0"],
    "reserved": ["all rights reserved"],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-warranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-name": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-warranty": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "gpl-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
}
#: Rules in the order of report, (licence, identifiers).
RULES = [
    ("Apache-2.0", ["apache-note"]),
    ("Apache-2.0", ["apache-use", "apache-copy", "apache-basis", "apache-see"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"]),
    ("CC-BY-4.0", ["ccby-note"]),
    ("CC-BY-NC-4.0", ["ccbync-note"]),
    ("CC0-1.0", ["cc0-note"]),
    ("GPL-3.0-only", ["gpl3-note"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-warranty"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("MIT", ["mit-note"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT-0", ["mit-grant", "mit-warranty"]),
    ("Proprietary", ["reserved"]),
]
#: Of these each known sentence holds one. None holds a blank, which stands for any run of other characters in a text.
TELLING = ["licen", "permi", "reserved", "notice", "warrant", "redistribution"]
#: What ends a sentence in the two readings.
ENDS = {"lines": r"[.!?;]+[ \t\r\n]+|[.!?;]+$|\n", "paragraphs": r"[.!?;]+[ \t\r\n]+|[.!?;]+$|:[ \t\r]*\n|\n[ \t\r]*\n"}

assert all(any(w in s for w in TELLING) for own in SENTENCES.values() for s in own)
assert all(re.fullmatch("[a-z0-9]+", w) for w in TELLING)
_BY_SENTENCE = {s: i for i, own in SENTENCES.items() for s in own}


def _identifiers(low: Column, ends: str) -> Column:
    """The known sentences of a lower-case text, in order."""
    cut = F.regexp_replace(F.regexp_replace(low, ends, "\x01"), "[^a-z0-9\x01]+", " ")
    known = F.filter(F.transform(F.split(cut, "\x01"), lambda s: F.trim(s)), lambda s: s.isin(list(_BY_SENTENCE)))
    names = F.create_map(*(F.lit(x) for pair in _BY_SENTENCE.items() for x in pair))
    return F.transform(known, lambda s: F.element_at(names, s))


def recognised(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, sentences (identifiers in order, when lines end sentences, joined by blanks),
    licenses (those whose rule holds, in the rules' order, joined by commas), n_licenses.

    Null and empty texts have none. Repeated rows give repeated rows; an empty table gives none. Of ``docs`` only doc_id and
    text are read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).alias("low"))
    telling = F.lit(False)
    for w in TELLING:
        telling = telling | F.contains("low", F.lit(w))
    none = F.expr("cast(array() as array<string>)")
    read = slim.withColumn("told", telling).select("doc_id", *(F.when(F.col("told"), _identifiers(F.col("low"), ends)).otherwise(none).alias(k) for k, ends in ENDS.items()))
    padded = [F.concat(F.lit(" "), F.array_join(k, " "), F.lit(" ")) for k in ENDS]
    holds = lambda rule: F.contains(padded[0], F.lit(f" {' '.join(rule)} ")) | F.contains(padded[1], F.lit(f" {' '.join(rule)} "))
    licenses = []
    for name in dict.fromkeys(n for n, _ in RULES):
        any_ = F.lit(False)
        for n, rule in RULES:
            if n == name:
                any_ = any_ | holds(rule)
        licenses.append(F.when(any_, F.lit(name)))
    found = read.select("doc_id", F.array_join("lines", " ").alias("sentences"), F.array_compact(F.array(*licenses)).alias("found"))
    return found.select("doc_id", "sentences", F.array_join("found", ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses"))


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognised(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def ids(ends: str) -> str:
        return (
            f"list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(low, '{ends}', chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g'), chr(1)), lambda x: trim(x)), "
            "lambda x: map_contains(names, x)), lambda x: names[x])"
        )

    pairs = ", ".join(f"'{s}': '{i}'" for s, i in _BY_SENTENCE.items())
    by_name: dict[str, list[str]] = {}
    for name, rule in RULES:
        key = f" {' '.join(rule)} "
        by_name.setdefault(name, []).append(f"contains(p1, '{key}') OR contains(p2, '{key}')")
    cases = ", ".join(f"CASE WHEN {' OR '.join(conditions)} THEN '{name}' END" for name, conditions in by_name.items())
    return f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, MAP {{{pairs}}} AS names FROM documents),
s AS (SELECT doc_id, array_to_string({ids(ENDS["lines"])}, ' ') AS sentences, array_to_string({ids(ENDS["paragraphs"])}, ' ') AS wrapped FROM d),
p AS (SELECT doc_id, sentences, ' ' || sentences || ' ' AS p1, ' ' || wrapped || ' ' AS p2 FROM s),
f AS (SELECT doc_id, sentences, list_filter([{cases}], lambda x: x IS NOT NULL) AS found FROM p)
SELECT doc_id, sentences, array_to_string(found, ',') AS licenses, CAST(len(found) AS BIGINT) AS n_licenses FROM f
"""


SQL = _sql()
