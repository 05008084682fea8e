"""Events that fall between two seconds, or are worth nothing, seen as bars and trades."""

import datetime as dt

import pytest

import __spark_entry__

DAY = dt.datetime(2024, 1, 25)  # no month has this number: no file's dates can be read in two ways


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Two users' events, one of them 0.3 seconds before a bar begins and worth nothing, another half a second after an even one."""
    folder = tmp_path_factory.mktemp("events")
    at = lambda hours, seconds: DAY + dt.timedelta(hours=hours, seconds=seconds)
    rows = [
        (3, at(0, 5), 1, "click", 5.0, "a"), (4, at(2, -0.3), 1, "click", 0.0, "b"), (12, at(4, 100.5), 1, "click", 7.0, "c"),
        (13, at(6, 0.25), 2, "click", 9.0, "d"), (14, at(8, -0.5), 2, "click", 4.0, "e"), (15, at(10, -0.7), 2, "click", 6.0, "f"),
    ]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


NAMES = (
    "bar_coverage", "bar_files", "bar_gaps", "bar_provenance", "bar_quality", "bar_verdicts", "evidence_attached", "evidence_counts", "evidence_statuses",
    "excursion_evidence", "excursion_status_counts", "mixed_evidence",
)


@pytest.mark.parametrize("name", NAMES)
def test_equals_its_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    found = __spark_entry__.queries()[name](spark, sf_dir)
    database = duckdb.connect()
    database.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet/*.parquet')")
    asked = database.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in asked.description]
    wanted = [tuple(row[names.index(c)] for c in found.columns) for row in asked.fetchall()]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))
