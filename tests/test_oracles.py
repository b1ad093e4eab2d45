"""Every evidence query against its DuckDB oracle, on the smallest tables."""

import duckdb
import pytest

from quarrylight.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    """Rows by sorted column, numbers rounded, in order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "" if v is None else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([[show(r[i]) for i in order] for r in data])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equal(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_without_the_training_data_operators(monkeypatch):
    import __spark_entry__ as entry

    def missing(name, real=entry.import_module):
        if "llm" in name:
            raise ModuleNotFoundError(f"No module named {name}")
        return real(name)

    monkeypatch.setattr(entry, "import_module", missing)
    with pytest.warns(UserWarning, match="without the training-data operators"):
        entry.queries()
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
