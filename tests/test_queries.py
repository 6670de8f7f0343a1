"""Every registered query of the library against its SQL on the small tables."""

import pytest
from tests.conftest import same_rows

from floodgauge import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, sf_dir, name):
    same_rows(catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.SQL[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
