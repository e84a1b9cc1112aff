import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from shroud.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4, extra={"spark.sql.adaptive.enabled": "true"})
    yield s
    s.stop()
