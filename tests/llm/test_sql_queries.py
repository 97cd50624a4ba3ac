"""Operators that SQL can express, against DuckDB, and against small fixtures."""

import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import licenses, registry, rules


def rows(names, data):
    # Strings before numbers, and nulls apart, so that rows can be sorted.
    return sorted(tuple((v is None, str(v)) for v in (r[names.index(n)] for n in sorted(names))) for r in data)


def same(df, con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    same(registry.QUERIES[name](spark, sf_dir), con, registry.SQL[name])


TEXTS = [
    (1, None), (2, ""), (3, "MIT  License; the mit-license. mitlicense amit license"), (4, "General\nPublic\tLicense Apache license"),
    (5, "a b c a b c a b c\nx\nx\n\nx \n###"), (5, "a b c a b c a b c\nx\nx\n\nx \n###"), (None, "Released under the MIT License."), (7, "EIN ÜÖ 5 é1 " * 30),
    (8, "w w w w w"), (9, "x y"), (10, "licensed under cc by-nc 4.0\nnothing"), (11, "under mit the license released"), (12, "😀mit license"), (13, "mit license😀"),
    (14, "x\n// Permission is hereby granted, free of charge,\n// to any person obtaining a copy of this\n// software and associated documentation files\n" + "z " * 60),
    (15, "Released\nunder\nthe MIT\nLicense"), (16, "\u212Apache license. M\u0130T LICENSE \u0130\n released under the m\u0131t license"), (17, " mit license "), (18, "."), (19, "a."), (20, ".a"),
]


@pytest.mark.parametrize("operator,sql", [(rules.judged, rules.judged_sql()), (licenses.scan, licenses.scan_sql())])
def test_fixture_matches_sql(spark, operator, sql):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("label", F.lit(1))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", TEXTS)
    same(operator(df), con, sql)


def test_odd_rows(odd, empty):
    for operator in (rules.judged, licenses.scan):
        assert operator(odd).count() == odd.count() and operator(empty).count() == 0
    got = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert got[7]["labels"] == "mit" and got[7]["score"] == 1.0 and got[1]["n_words"] == 0 and got[1]["score"] == 0.0


def test_similarity_join_is_exact(spark):
    templates = (("a", "alpha beta gamma delta"), ("b", "gamma delta epsilon"), ("c", "rare"))
    lines = ["alpha beta gamma", "delta gamma x y z", "epsilon gamma delta alpha beta", "rare", "x", "", "Alpha, BETA; delta! gamma"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    for t in (0.3, 0.6, 0.75, 1.0):
        want = set()
        for i, x in enumerate(lines):
            have = set(licenses.tokens(x))
            for label, text in templates:
                s = set(licenses.tokens(text))
                if len(have & s) >= t * len(s) - 1e-9:
                    want.add((i, label, len(have & s) / len(s)))
        got = licenses.similarity_join(licenses.profiled(licenses._keyed(df, "doc_id", "text"), templates, t), templates, t)
        assert {(r["_id"], r["label"], r["score"]) for r in got.collect()} == want


def test_native_plan(spark, sf_dir):
    plan = registry.QUERIES["op4_licenses"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ablations(spark):
    entries = spark.createDataFrame([(m,) for m in (0, 0, 1, 2, 3, 4, 4, 128)], "failed int")
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept"]) for r in rules.ablations(entries, "v1").collect()}
    assert got == {"few_words": (2, 1, 4), "repeats": (2, 1, 4), "symbols": (2, 2, 5)} | {"duplicate_lines": (0, 0, 3)}


def test_wrapped_notices(spark):
    """Every template, wrapped at 40 columns with comment signs inside prose; and its tokens too far apart."""
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        wrapped = "\n".join(f" * {x}" for x in textwrap.wrap("Copyright Foo. " + text + ". Bar baz", 40))
        rows += [(k, "some prose here\n" * 40 + wrapped + "\nqux" * 50), (100 + k, "\n".join(w + " z" * 40 for w in text.split()))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1.0
        assert got[100 + k]["labels"] == "" and got[100 + k]["score"] == 0.0
