import re

import duckdb
import pandas as pd

from weftgraph.llm import license_rules as m

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"] + [f"{i}. {m.SENTENCES[k][0]}." for i, k in enumerate(["bsd-source", "bsd-binary", "bsd-name"], 1)] + [m.SENTENCES["bsd-warranty"][0] + "."]
TEXTS = [
    MIT, MIT.replace("The above copyright notice", "That copyright notice"), "\n".join(BSD), "\n".join(BSD[:3] + BSD[4:]), "\n".join(BSD[::-1]), "Released under the MIT License.", "Lorem. Released under the MIT License. Ipsum", "no end\nLicensed under CC BY-NC 4.0.\nmore",
    "Licensed under the Apache License, Version 2.0. All rights reserved.", "not released under the MIT License.", "", None, "   ", "ÉÜ LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3!", "// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: Apache-2.0", "x " * 50000 + ". Released under the MIT license.", "licensed under the\nmit license.",
]


def brute(text):
    low = (text or "").lower()
    readings = []
    for ends in m.ENDS.values():
        parts = re.split(ends, low)
        names = {s: i for i, own in m.SENTENCES.items() for s in own}
        readings.append([names[s] for p in parts if (s := " ".join(re.findall("[a-z0-9]+", p))) in names])
    runs = lambda seq, rule: any(seq[i : i + len(rule)] == rule for i in range(len(seq)))
    found = list(dict.fromkeys(n for n, rule in m.RULES if any(runs(s, rule) for s in readings)))
    return " ".join(readings[0]), ",".join(found), len(found)


def test_matches_brute_force_and_sql(spark):
    rows = [(i, t, "low", 1) for i, t in enumerate(TEXTS)] + [(None, "All rights reserved.", "", 0), (0, MIT, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, low string, found int")
    got = sorted((tuple(r) for r in m.recognised(docs).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    by_id = {r[0]: r[2] for r in got}
    assert [by_id[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 14, 16)] == ["MIT", "MIT-0", "BSD-3-Clause", "BSD-2-Clause", "", "MIT", "MIT", "CC-BY-NC-4.0", "Apache-2.0,Proprietary", "", "GPL-3.0-only", "Apache-2.0,MIT", "MIT"]
    con = duckdb.connect()
    con.register("raw", pd.DataFrame([(None if i is None else str(i), t) for i, t, *_ in rows], columns=["doc_id", "text"]))
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM raw")
    assert sorted(con.execute(m.SQL).fetchall(), key=str) == got


def test_a_known_sentence_counts_whatever_stands_between_its_words(spark):
    texts = ["All rights\nreserved.", "All rights  reserved.", "all rights\treserved", "All rights\u00a0reserved.", "All\r\nrights -- reserved!", "ALL RIGHTS *RESERVED*", "all rights re served", "reserved"]
    got = sorted(tuple(r) for r in m.recognised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == [(i, *brute(t)) for i, t in enumerate(texts)]
    assert [r[1] for r in got] == ["", "reserved", "reserved", "reserved", "", "reserved", "", ""]
    assert [r[2] for r in got] == ["Proprietary"] * 6 + ["", ""]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"]))
    assert sorted(con.execute(m.SQL).fetchall()) == got


def test_native_plan_and_empty_table(spark):
    out = m.recognised(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
