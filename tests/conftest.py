import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


CHUNK = "chunk_id string, content string, metadata struct<filename:string,doc_type:string,ingestion_timestamp:string,page_count:int,source_path:string,chunk_count:int>, page_number int, chunk_index int, embedding array<float>"


def make_chunks(spark, rows):
    """rows: (chunk_id, content, filename, embedding)."""
    return spark.createDataFrame([(i, t, (f, "PDF", "2024-01-01T00:00:00", 10, "", 5), 1, k, e) for k, (i, t, f, e) in enumerate(rows)], CHUNK)


@pytest.fixture
def chunks_of(spark):
    return lambda rows: make_chunks(spark, rows)
