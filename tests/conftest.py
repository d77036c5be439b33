import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from larder.session import build_session
    s = build_session(cpus=4, shuffle_partitions=4, memory="4g")
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # several batches per partition
    yield s
    s.stop()
