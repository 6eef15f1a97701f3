import shutil

import pytest
from pyspark.sql import functions as F

from curatrix.plans import registry
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, name):
    check(spark, SF, registry.QUERIES[name], registry.SQL[name])


def test_every_query_is_registered(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["component", "primary_id", "n_members"]


def test_times_of_large_ids(spark, tmp_path):
    """Ids of larger copies give years beyond 9999, and more nanoseconds than a long holds."""
    d = f"{tmp_path}/large"
    shutil.copytree(SF, d)
    events = spark.read.parquet(f"{SF}/events.parquet")
    shutil.rmtree(f"{d}/events.parquet", ignore_errors=True)
    (tmp_path / "large/events.parquet").unlink(missing_ok=True)
    part = f"{tmp_path}/part"
    events.withColumn("event_id", F.col("event_id") + F.expr("case when event_id % 2 = 0 then 6000000 else 12000000 end")).coalesce(1).write.parquet(part)
    shutil.move(next(tmp_path.glob("part/*.parquet")), f"{d}/events.parquet")
    check(spark, d, registry.loose_datetime, registry.SQL["loose_datetime"])
