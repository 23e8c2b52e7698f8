from __future__ import annotations

import pytest

from quire.session import local_session, ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="4g")
    ship(session)
    return session


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
