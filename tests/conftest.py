from __future__ import annotations

import os

import pytest

from parlance.session import build_session, shared_dir, ship_package

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("OFF")
    shared_dir(session)
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def tables(spark, data):
    from parlance.plans.registry import Tables

    return Tables(spark, data)


@pytest.fixture
def schema_name(spark, request):
    from parlance.sources.tables import scratch_schema

    return scratch_schema(spark, "test_schema")
