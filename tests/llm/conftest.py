import duckdb
import pytest


@pytest.fixture
def against_sql():
    """Compare a DataFrame with SQL over small tables, given as (name, DataFrame)."""
    def compare(df, sql, **tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            arrow = frame.toArrow()  # noqa: F841
            con.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow")
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        key = lambda r: tuple((x is not None, x) for x in r)
        expected = sorted(cursor.fetchall(), key=key)
        got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
        assert got == expected
        return got

    return compare


DOCUMENTS = "doc_id bigint, text string, source string, lang string, size string, row string"
EDGES = [
    (1, "same line\nown one\n\nsame line", "a", "en", "x", "y"), (2, "same line\nother", "a", "en", "x", "y"),
    (2, "same line\nother", "a", "en", "x", "y"), (3, None, "a", None, None, None), (4, "", "b", "en", "x", "y"),
    (5, " \n\t\n", None, None, "x", "y"), (None, "no id here", None, None, "x", "y"), (None, "no id here", None, None, "x", "y"),
    (6, "word " * 60_000, "c", "en", "x", "y"), (7, "é ü\n" * 3, "b", "de", "x", "y"), (8, "same line", "b", "en", "x", "y"),
]


@pytest.fixture
def edges(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns named like those that operators make."""
    return spark.createDataFrame(EDGES, DOCUMENTS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
