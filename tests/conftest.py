import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corposcope.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def corpus(spark):
    def make(files):
        rows = list(files.items()) if isinstance(files, dict) else files
        return spark.createDataFrame(rows, "path STRING, content STRING")

    return make
