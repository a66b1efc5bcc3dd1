import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from assetlake import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", "local[8]", 4, {"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                                "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
