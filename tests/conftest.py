import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opslens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session


LINES = "file STRING, chunk BIGINT, pos BIGINT, value STRING"


@pytest.fixture
def lines(spark):
    """Line table of texts; ``chunk`` lines go into one chunk, so small chunks test the hand-over."""
    def make(texts, file="f", chunk=3):
        if isinstance(texts, str):
            texts = texts.split("\n")
        named = texts if isinstance(texts, dict) else {file: texts}
        rows = [(name, i // chunk, i, value) for name, values in named.items() for i, value in enumerate(values)]
        return spark.createDataFrame(rows, LINES).repartition(4)
    return make
