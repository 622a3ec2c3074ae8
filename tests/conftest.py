import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weirflow.session import local_session, ship

    session = local_session(cpus=4, shuffle_partitions=4, memory="4g")
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # tiny inputs: compiling takes longer than running
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    ship(session)
    yield session
    session.stop()
