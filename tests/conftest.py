import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from weirlog.schema import CLEAN_SCHEMA, RAW_SCHEMA  # noqa: E402
from weirlog.session import get_session  # noqa: E402
from weirlog.sources import sample_views  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": str(warehouse),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def logs(spark):
    return sample_views.logs(spark, SMALL)


@pytest.fixture(scope="session")
def raw(spark):
    return sample_views.raw_logs(spark, SMALL)


@pytest.fixture(scope="session")
def make_raw(spark):
    """Raw rows from field overrides."""
    base = {
        "timestamp": "2024-01-01 00:00:00",
        "service_name": "auth-service",
        "endpoint": "/login",
        "status_code": "200",
        "response_time_ms": "100",
        "release_version": "v1.0",
        "server_region": "us-east",
    }

    def make(*overrides):
        return spark.createDataFrame([tuple({**base, **o}.values()) for o in overrides], RAW_SCHEMA)

    return make


@pytest.fixture(scope="session")
def make_logs(spark):
    """Clean rows from field overrides; rows are a minute apart unless a timestamp is given."""

    def make(*overrides):
        rows = []
        for i, override in enumerate(overrides):
            row = {
                "timestamp": datetime(2024, 1, 1) + timedelta(minutes=i),
                "service_name": "auth-service",
                "endpoint": "/login",
                "status_code": 200,
                "response_time_ms": 100,
                "release_version": "v1.0",
                "server_region": "us-east",
                **override,
            }
            rows.append(tuple(row.values()))
        return spark.createDataFrame(rows, CLEAN_SCHEMA)

    return make


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
