import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from govspark.session import build_session

    scratch = {
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = build_session("tests", cores=8, **scratch)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def texts(spark):
    """Rows of text in a given order, as a frame with ``n`` and ``text``."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "n int, text string")

    return make


def column(df, name, order="n"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


@pytest.fixture
def values():
    return column
