import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from phrasemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "phrasemill-tests")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Examples from (input, output_json) pairs."""

    def build(*pairs):
        rows = [(i, text, out) for i, (text, out) in enumerate(pairs)]
        return spark.createDataFrame(rows, "example_id bigint, input string, output_json string")

    return build
