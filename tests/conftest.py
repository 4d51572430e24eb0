from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fundaflow.session import local_session  # noqa: E402


def pytest_configure(config):
    config.addinivalue_line("markers", "twins: every registered query against its SQL twin; runs with -m twins only")


def pytest_collection_modifyitems(config, items):
    if "twins" not in (config.option.markexpr or ""):
        for item in items:
            if "twins" in item.keywords:
                item.add_marker(pytest.mark.skip(reason="runs with -m twins"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, app="tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
