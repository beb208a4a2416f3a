import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def spark():
    from veilspark.session import build_session

    return build_session("4", "tests", "4g")


@pytest.fixture(scope="session")
def sf_dir():
    p = Path("/root/testdata/sf0.001")
    if not p.exists():
        pytest.skip("no test data")
    return str(p)
