import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from leadline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "leadline-tests", str(tmp_path_factory.mktemp("stages")))
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
