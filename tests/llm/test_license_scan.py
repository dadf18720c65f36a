import hashlib
import re

import duckdb

from halyard.llm import license_scan as ls


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    return {r["doc_id"]: r for r in ls.scan(df).collect()}


def test_variants_of_one_licence(spark):
    mit = "The MIT Licence (MIT)\n\nCopyright (c) 2019 Some One\nCopyright © 2020 Another\nAll rights reserved.\n\n" + ls._MIT.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ; ")
    rows = [(1, mit, "x"), (2, ls._MIT + " and more", "x"), (3, ls._ISC.replace(", ", ",\n").replace(" ", "\t "), "x"), (4, "some words\nreleased  under the  mit LICENCE!\nmore", "x")]
    out = got(spark, rows)
    assert [out[i]["license_id"] for i in (1, 2, 3, 4)] == ["MIT", None, "ISC", None]
    assert [out[i]["n_license_lines"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and out[4]["line_licenses"] == "MIT"


NOTICES = ["Copyright John Smith 2019", "Copyright, 2019 X", "Copyright The Foo Authors", "Copyright: 2020 Foo and Bar", "Portions Copyright (c) 2001 A. B.", "# Copyright (c) 2001 A. B.", " * copyright 2003-2010 the team", "// Copyright Jane Doe <jane@x.org>", "(c) Me", "(C) 2011 someone", "© anyone"]
PROSE = ["copyright notice and this permission notice shall be included", "Copyright holders be liable for any claim", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "copyright law applies", "Copyright protects the work", "(c) You must retain all notices"]


def test_copyright_lines_and_prose(spark):
    rows = [(i, f"{n}\n\n{ls._MIT}", "x") for i, n in enumerate(NOTICES)] + [(100 + i, n, "x") for i, n in enumerate(PROSE)]
    out = got(spark, rows)
    assert [out[i]["license_id"] for i in range(len(NOTICES))] == ["MIT"] * len(NOTICES)
    plain = [hashlib.sha256(re.sub("[^a-z]+", " ", n.lower()).strip().encode()).hexdigest() for n in PROSE]
    assert [out[100 + i]["digest"] for i in range(len(PROSE))] == plain


def test_neighbouring_spellings(spark):
    rows = [(1, "licence licence terms", "x"), (2, "license license terms", "x"), (3, "Non-commercial non commercial sub-licence centre licence", "x"), (4, "noncommercial noncommercial sublicense center license", "x"), (5, "licence\nlicence", "x"), (6, "license license", "x")]
    out = got(spark, rows)
    assert out[1]["digest"] == out[2]["digest"] and out[3]["digest"] == out[4]["digest"] and out[5]["digest"] == out[6]["digest"]
    assert len({out[i]["digest"] for i in (1, 3, 5)}) == 3
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    rows += [(10 + i, f"{n}\n{ls._MIT}", "x") for i, n in enumerate(NOTICES + PROSE)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    want = con.execute(ls.SQL).fetchall()
    assert sorted(map(tuple, got(spark, rows).values()), key=str) == sorted(want, key=str)


def test_whole_texts_are_found_under_another_layout(spark):
    whole = {name: t for name, t in ls.CATALOGUE if len(t) > 6000}
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "CC0-1.0"} <= set(whole)
    rows = [(i, re.sub(r"(?<=[a-z,])\n[ \t]*(?=[a-z])", " ", t).replace(",", " ;\t"), "x") for i, t in enumerate(whole.values())]
    out = got(spark, rows)
    assert [out[i]["license_id"] for i in range(len(rows))] == list(whole)


def test_every_catalogue_text_is_found(spark):
    rows = [(i, t, "x") for i, (_, t) in enumerate(ls.CATALOGUE)]
    out = got(spark, rows)
    assert all(out[i]["license_id"] == name for i, (name, _) in enumerate(ls.CATALOGUE))


def test_cases(spark):
    notice = ls.CATALOGUE[3][1]
    rows = [(1, None, "x"), (2, "", "x"), (3, "©® 日本", "x"), (None, notice, "x"), (4, "word " * 100_000 + "\n" + notice, "x"), (5, notice, "x"), (5, notice, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    out = ls.scan(df).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["digest"] is None and by[i]["license_id"] is None for i in (1, 2, 3))
    assert by[None]["license_id"] == by[5]["license_id"] == "MIT"
    assert by[4]["n_license_lines"] == 1 and by[5]["n_license_lines"] == 2 and by[None]["n_license_lines"] == 1
    plain = re.sub("[^a-z0-9]+", " ", "word " * 100_000 + notice.lower()).strip()
    assert by[4]["digest"] == hashlib.sha256(plain.encode()).hexdigest()
    assert ls.scan(df.limit(0)).count() == 0


def test_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(ls.SQL).fetchall()
    assert sorted(map(tuple, ls.scan(spark.read.parquet(path)).collect()), key=str) == sorted(want, key=str)


def test_plan_is_native(spark):
    plan = ls.scan(spark.createDataFrame([], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
