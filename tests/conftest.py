from __future__ import annotations

import pytest

from machinepulse.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(
        8,
        **{
            "spark.sql.warehouse.dir": str(warehouse),
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.dataFrameQueryContext.enabled": "false",
        },
    )
    yield session
    session.stop()
