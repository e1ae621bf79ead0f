import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from concord.session import ensure_checkpoint_dir, local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="concord-tests")
    # tests are the one place that sets its own checkpoint folder (unset here)
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="concord-test-ckpt-"))
    yield s
    s.stop()
