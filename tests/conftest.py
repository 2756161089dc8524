import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")]
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from treeline.session import local_session

    session = local_session("8", partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
