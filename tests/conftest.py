import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tidewheel.session import get_spark

    session = get_spark("tests", cores=4, partitions=4)
    session.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent)
    yield session
    session.stop()
