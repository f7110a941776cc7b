"""Every registered query of the library against DuckDB on the same tables."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from parity import connect, duck_rows, spark_rows

from ferryline.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert got == duck_rows(con, ORACLES[name])
    else:
        assert got[0]


#: Rows that the small tables lack.
FURTHER = {
    "f_to_char_scale": ("part", {"p_partkey": [0, 1, 99_999, 100_000, 1_199_999, 10**9 + 7, 10**15 + 1, -250_000, None]}),
    # Quotients beside and on the middle between two texts, more digits than the tables have, and values that are no numbers.
    "x_format_reading": ("events", {"event_id": [16_532, 19_013, 20_048, 1, 1, 1, 2, 4, 5, 11, 12, 3, 1, 2, 4, None], "value": [91.75, 101.5, 173.75, 1125.0, 1135.0, 0.13, -1e9, 1e9, 560.21, 7.0, -7.0, -7.0, float("nan"), float("inf"), float("-inf"), 5.0]}),
}


@pytest.mark.parametrize("name", sorted(FURTHER))
def test_query_on_further_rows(spark, tmp_path, name):
    tab, columns = FURTHER[name]
    pq.write_table(pa.table(columns), tmp_path / f"{tab}.parquet")
    assert spark_rows(QUERIES[name](spark, str(tmp_path))) == duck_rows(connect(tmp_path), ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
