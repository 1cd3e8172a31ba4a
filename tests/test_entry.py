import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["list_records", "count_records", "envelope", "record_json", "written_records"])
def test_matches_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    got = e.queries()[name](spark, SF)
    want = db.execute(e.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) != []


def test_entry(spark):
    assert e.entry(spark).count() == 150


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_mistyped_import_is_not_hidden(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("No module named 'corvane.mistyped'", name="corvane.mistyped")

    monkeypatch.setattr(e.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()


@pytest.mark.parametrize("missing", ["corpus_pipeline", "corvane.llm", "tokenizers"])
def test_queries_without_the_corpora(monkeypatch, missing):
    def absent(name):
        raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)

    monkeypatch.setattr(e.importlib, "import_module", absent)
    assert list(e.queries()) == list(e.oracle_sql()) == ["list_records", "count_records", "envelope", "record_json", "written_records"]
