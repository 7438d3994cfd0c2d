import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyforge.session import build_session

    s = build_session("local[4]", "tests", shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()
