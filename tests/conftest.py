import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

sys.path.insert(0, str(ROOT / "tests"))

from hand import SF  # noqa: E402
from spendlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, 4, **{"spark.checkpoint.dir": str(shared)})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def facts(spark):
    from spendlens.sources import bound

    return bound.facts(spark, SF)


@pytest.fixture(scope="session")
def raw(spark):
    from spendlens.sources import bound

    return bound.raw(spark, SF)
