import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from codevitals.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """{path: text} -> files table of one repository."""
    from codevitals.schema import FILES

    def build(texts: dict, repo_id: str = "r"):
        rows = [(repo_id, path, "." + path.rsplit(".", 1)[-1], text, True, 0.0)
                for path, text in texts.items()]
        return spark.createDataFrame(rows, FILES)

    return build
