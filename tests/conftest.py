import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docketry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(shared_folder):
    # Tiny tables need few tasks; the shared folder is named as a cluster would name it.
    settings = {
        "spark.sql.leafNodeDefaultParallelism": "2",
        "spark.checkpoint.dir": shared_folder,
    }
    session = local_session("8", partitions=2, memory="6g", **settings)
    yield session
    session.stop()
