"""The driver's entry points."""

import pytest

import __spark_entry__ as e


def test_entry_runs_a_registered_query(spark):
    assert e.registry.FLAGSHIP in e.queries()
    assert e.entry(spark).count() > 0


def test_both_versions_of_symbols_are_parsed_at_once(spark, monkeypatch):
    calls = []

    class Stop(Exception):
        pass

    def told(files, keys=("path",)):
        calls.append((keys, files.count()))
        raise Stop

    monkeypatch.setattr(e.registry.symbols, "parse_symbols", told)
    with pytest.raises(Stop):
        e.queries()["symbol_changes"](spark, e.SMALLEST)
    assert calls == [(("version", "path"), 2 * spark.read.parquet(f"{e.SMALLEST}/part.parquet").count())]
