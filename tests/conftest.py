from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallysift.session import session

    shared = tmp_path_factory.mktemp("shared")
    spark = session(
        "tests",
        "local[4]",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
        spark_driver_memory="4g",
        spark_checkpoint_dir=f"file://{shared}",
        spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
        spark_sql_streaming_stateStore_providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
