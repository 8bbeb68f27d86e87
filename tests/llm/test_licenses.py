"""Licence scans against SQL and on texts of known licences."""

from compare import connect, difference
from pyspark.sql import functions as F

from phrasemill.llm.licenses import recognise
from phrasemill.llm.queries import ORACLE, op1_license_scan

SF = "/root/testdata/sf0.01"
BSD = """Copyright (c) 2019, Some One. All rights reserved.
Redistribution and use in source and binary forms are permitted provided that:
1. Redistributions of source code must retain the above copyright
   notice and this list.
2. Redistributions in binary form must reproduce the above
   copyright notice."""
CASES = {
    "Some text.\nLicensed under the Apache License, Version 2.0.\nMore": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "under the GNU General Public\nLicense as published, either version 2 of the License, or (at your option) any later version.":
        "GPL-2.0-or-later",
    "a table | b\nReleased under the MIT license. And then: Licensed under the Mozilla Public License v2.0": "MPL-2.0,MIT",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this "
    "permission notice shall be included. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY.": "MIT",
    BSD: "BSD-2-Clause,all-rights-reserved",
    BSD + "\n3. Neither the name of it may be used to endorse or promote products.": "BSD-3-Clause,all-rights-reserved",
    "Released under the MIT License. Released under the MIT License.": "MIT",
    "Licensed under terms of our own": "",
    "He was a driver without any papers.": "",
}


def test_table_against_sql(spark):
    with connect(SF) as con:
        assert difference(op1_license_scan(spark, SF), con, ORACLE["op1_license_scan"]) == ""
    counts = {r.licences: r["count"] for r in op1_license_scan(spark, SF).groupBy("licences").count().collect()}
    assert {"GPL-3.0-only", "CC-BY-NC", "MIT", "Apache-2.0"} <= set(counts)


def test_known_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id int, text string")
    rows = {r.text: r for r in recognise(df).collect()}
    assert {t: r.licences for t, r in rows.items()} == CASES
    assert rows["Licensed under terms of our own"].n_unknown == 1
    assert [s.ids for s in rows["Released under the MIT License. Released under the MIT License."].sentences] == [["MIT"], ["MIT"]]


def test_edges(spark):
    long = "word " * 200_000 + ". Released under the MIT License."
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, None), (None, "gnu", "x")],
                               "doc_id int, text string, sequence string")
    out = recognise(df)
    assert out.columns == ["doc_id", "text", "sentences", "sequence", "licences", "n_unknown"]
    assert sorted((str(r.doc_id), r.licences, r.n_unknown, r.sequence) for r in out.collect()) == [
        ("1", "", 0, ""), ("2", "", 0, ""), ("3", "MIT", 0, "MIT"), ("3", "MIT", 0, "MIT"), ("None", "", 0, "")]
    assert recognise(df.where(F.lit(False))).count() == 0


def test_no_shuffle_and_no_python(spark):
    plan = op1_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow"))
