import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from sagekeep.runtime import build_session

    # Small tables spend their time in compiling and scheduling; neither is needed here.
    quick = {
        "spark.sql.shuffle.partitions": "2",
        "spark.driver.memory": "6g",
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.default.parallelism": "2",
        "spark.sql.sources.parallelPartitionDiscovery.threshold": "1000",
    }
    session = build_session("tests", 4, **quick)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    """The folder of the smallest tables; tests that need it are skipped without it."""
    folder = f"{DATA}/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    return folder


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
