"""Shared session for the tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """A local session with a checkpoint folder of its own."""
    from quillon.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="3g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield session
    session.stop()


def rows(df) -> list[tuple]:
    """All rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
