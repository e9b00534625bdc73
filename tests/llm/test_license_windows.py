import duckdb
import pytest

from lithoframe.llm import license_dice as ld

GPL = """/*
 * This file is part of frob, a tool of many uses.
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
""" + "".join(f"int f{k}(int a, int b) {{ return a + {k} * b; }}\n" for k in range(20))


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.unit, r.license): r.dice for r in ld.find_licenses(df, windows=True).collect()}


def test_commented_header_and_notice_within_a_line(spark):
    line = "All code in this folder was written by hand. Released under the MIT License. Have fun."
    got = found(spark, GPL, line, "// code\n# SPDX-License-Identifier: Apache-2.0 and so on\n", "MIT License was released under the sea.", None, "")
    assert got[0, "window", "GPL-3.0"] == 1.0 and got[1, "window", "MIT"] == 1.0 and got[2, "window", "Apache-2.0"] == 1.0
    assert {k[0] for k in got} == {0, 1, 2}


def test_units_come_before_windows_and_changed_notices_are_found(spark):
    notice = dict(ld.TEMPLATES)["CDDL-1.0"]
    changed = notice.replace("file", "module").replace("contents", "content")
    got = found(spark, notice, f"Some words before it. {changed} And some behind it, in one line.", " ".join(f"t{k}" for k in range(5000)) + " " + notice)
    assert {k: v for k, v in got.items() if k[2] == "CDDL-1.0"} == {(0, "line", "CDDL-1.0"): 1.0, (1, "window", "CDDL-1.0"): pytest.approx(got[1, "window", "CDDL-1.0"]), (2, "window", "CDDL-1.0"): 1.0}
    assert got[1, "window", "CDDL-1.0"] < 1.0


def test_texts_under_one_id_are_reported_each(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (1, "This project is licensed under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.unit, r.license) for r in ld.find_licenses(df, windows=True).collect()) == [("1", "line", "MIT"), ("1", "line", "MIT"), ("None", "line", "MIT")]


@pytest.mark.parametrize("size", ["sf0.001"])
def test_against_sql(spark, size):
    at = f"/root/testdata/{size}/documents.parquet"
    mixed = spark.read.parquet(at).select("doc_id", "text").union(spark.createDataFrame([(10**6 + k, f"some {'words ' * k}{t} and more of them{' here' * k}") for k, (_, t) in enumerate(ld.TEMPLATES)], "doc_id long, text string"))
    got = sorted((r.doc_id, r.unit, r.place, r.license, round(r.dice, 9)) for r in ld.find_licenses(mixed, windows=True).collect())
    con = duckdb.connect()
    con.register("documents", mixed.toPandas())
    want = sorted((r[0], r[1], r[2], r[3], round(r[4], 9)) for r in con.sql(f"SELECT doc_id, unit, place, license, dice FROM ({ld.oracle()})").fetchall())
    assert got == want and sum(1 for r in got if r[1] == "window") > 50


def test_a_full_licence_as_template(spark):
    body = " ".join(f"clause{k} grants rights{k % 7} under part{k // 3}" for k in range(700))
    templates = (("Long-1.0", body), *ld.TEMPLATES[:3])
    df = spark.createDataFrame([(1, body.replace("clause5 ", "")), (2, "before it " + body + " after it"), (3, "clause5 grants rights5")], "doc_id long, text string")
    got = {(r.doc_id, r.unit): r.dice for r in ld.find_licenses(df, templates=templates, windows=True).collect()}
    assert got.keys() == {(1, "line"), (2, "line")} and min(got.values()) > 0.99
