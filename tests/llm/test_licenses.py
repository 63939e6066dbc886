from __future__ import annotations

import textwrap

from millrace.llm import licenses
from millrace.llm.queries import op10_license_scan, oracle_sql
from tests.test_entry import same


def test_variants_of_a_text_are_found(spark):
    text = licenses.LICENSES["MIT"]
    changed = "Copyright (c) 2020 Somebody\n\n" + text.upper().replace(",", " ;").replace("\n", "  \n\n")
    rows = [(1, text), (2, changed), (3, text + " and more"), (4, None), (5, ""), (1, text), (6, "x" * 200_000)]
    rows += [(7, "Licensed under CC BY-NC 4.0."), (8, "licensed under cc by-nc 4.0"), (9, "!!!")]
    docs = spark.createDataFrame([(*r, "d", "l") for r in rows], "doc_id long, text string, digest string, license_id string")
    rows = licenses.license_scan(docs).collect()
    found = [(r.doc_id, r.license_id) for r in rows]
    notice = "CC-BY-NC-4.0"
    assert {(r.license_id, r.kind) for r in rows} == {("MIT", "text"), (notice, "notice"), (None, None)}
    assert sorted(found, key=str) == sorted(
        [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, notice), (8, notice), (9, None)], key=str
    )


def test_equivalent_spellings(spark):
    docs = spark.createDataFrame([(1, "This LICENCE forbids non-commercial use & more.")], "doc_id long, text string")
    found = licenses.license_scan(docs, licenses={"own": "this license forbids noncommercial use and more"}).first()
    assert found.license_id == "own"


def test_any_width_of_lines(spark):
    names = [n for n, text in licenses.LICENSES.items() if "(" not in n and len(text) > 500]
    assert len(names) >= 13
    rows = []
    for name in names:
        for width in range(50, 121):
            parts = [textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in licenses.LICENSES[name].split("\n\n")]
            head = f"Copyright (c) 20{width % 90 + 10} A. Holder\nAll rights reserved.\n\n"
            rows.append((name, head * (width % 2) + "\n\n".join(parts)))
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.license_id) for r in found if r.doc_id != r.license_id] == []


def test_only_statements_of_copyright_go(spark):
    known = {"own": "one (c) two\ncopyright holders three"}
    rows = [
        (1, "one\n(c) two\ncopyright holders\nthree"),
        (2, "Copyright 2020 X\n© Y\n (c) 1999 Z\none (c) two copyright owners three"),
        (3, "one\ntwo\ncopyright holders\nthree"),
    ]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses=known).collect()
    assert [r.license_id for r in sorted(found)] == ["own", "own", None]


def test_ties_go_to_the_smallest_id(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert licenses.license_scan(docs, licenses={"b": "Some text.", "a": "some  TEXT", "c": "some text"}).first().license_id == "a"


def test_known_texts_differ(spark):
    assert licenses.known_licenses(spark).count() == len(licenses.LICENSES)


def test_matches_its_sql(spark):
    same(spark, op10_license_scan, oracle_sql()["op10_license_scan"], ["documents"])


def test_query_on_licenses_of_every_kind(spark, tmp_path):
    import duckdb

    rows = [(i, text.replace("\n", "\r\n"), name) for i, (name, _, text) in enumerate(licenses.KNOWN)]
    kinds = {i: (name, kind) for i, (name, kind, _) in enumerate(licenses.KNOWN)}
    spark.createDataFrame([*rows, (900, "no licence", "x"), (901, None, "x")], "doc_id long, text string, license_id string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op10_license_scan(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.license_id, r.kind) for r in found} == kinds | {900: (None, None), 901: (None, None)}
    assert {"text", "titled", "terms", "notice", "tag"} == {kind for _, kind in kinds.values()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(map(tuple, found)) == sorted(db.execute(oracle_sql()["op10_license_scan"]).fetchall())


def test_empty(nothing):
    assert licenses.license_scan(nothing).count() == 0


def test_whole_texts_of_long_licenses(spark):
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0"]
    rows = list(enumerate("  " + licenses.LICENSES[n].upper() for n in names if len(licenses.LICENSES[n]) > 5000))
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.license_id for r in sorted(found)] == names
