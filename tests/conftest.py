import os
import sys

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from landsieve.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "landsieve-tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def local(spark, rows, ddl):
    """Literal rows as a local relation, which needs no Python worker to scan."""
    schema = T.StructType.fromDDL(ddl)
    columns = [[row[i] for row in rows] for i in range(len(schema))]
    target = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target), schema)


@pytest.fixture
def scratch(spark):
    from landsieve import Scratch

    with Scratch(spark) as folder:
        yield folder
