import datetime

import pytest

from wardledger.schema import NATIVE_SCHEMA
from wardledger.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.master": "local[4]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    spark = session("tests", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def reports(spark):
    """Cost reports from (provider, year, beds, expenses, income[, state])."""

    def build(items):
        full = []
        for provider, year, beds, expenses, income, *state in items:
            full.append(
                (
                    provider,
                    f"Hospital {provider}",
                    "Springfield",
                    state[0] if state else "NY",
                    beds,
                    datetime.date(year, 12, 31) if year else None,
                    expenses,
                    None if expenses is None else expenses * 3,
                    income,
                    1, 2, 3, 4, 5,
                )
            )
        return spark.createDataFrame(full, NATIVE_SCHEMA)

    return build


def rows(df):
    return [tuple(r) for r in df.collect()]
