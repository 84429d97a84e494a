"""Queries against their SQL on tables with odd rows, which the driver's small tables don't hold."""

import duckdb
import pytest

import __spark_entry__ as entry


def against_sql(spark, folder, name, tables):
    """The query's rows and its SQL's, over ``tables`` (name: rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
        con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = [tuple(r[names.index(c)] for c in got.columns) for r in result.fetchall()]
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


BLANK = ["", " ", "\n", " \r\n ", None, "x\r\r\n", "\t\n　\n", "a\x00b\n\U0001f926 é", "\n\n"]


@pytest.mark.parametrize("name", ["line_offsets", "lines_split"])
def test_lines_of_blank_texts(spark, tmp_path, name):
    docs = [(i, BLANK[i % len(BLANK)]) for i in range(40)]
    got, want = against_sql(spark, tmp_path, name, {"documents": (docs, "doc_id bigint, text string")})
    assert got == want and len({r[0] for r in want}) == sum(t is not None for _, t in docs)


@pytest.mark.parametrize("name", ["line_offsets", "lines_split", "line_classify"])
def test_lines_of_numbers_below_zero(spark, tmp_path, name):
    docs = [(i, "One a\nTwo b\n\nThree c\nFour d") for i in range(-40, 40)]
    got, want = against_sql(spark, tmp_path, name, {"documents": (docs, "doc_id bigint, text string")})
    assert got == want and any(r[0].startswith("-") for r in want)


def test_keyword_faults_of_repeated_lists(spark, tmp_path):
    customers = [(None if i % 11 == 0 else i % 50, f"Customer#{i % 30}", ("FURNITURE", "fine", "ok", "Machinery", "ÉéÑ")[i % 5]) for i in range(400)]
    got, want = against_sql(spark, tmp_path, "kw_validate", {"customer": (customers, "c_custkey bigint, c_name string, c_mktsegment string")})
    assert got == want and any(r[0] is None and r[1] is None for r in want)
