import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
# task processes import the functions that tests hand to Spark
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH", "")])
sys.path[:0] = [os.path.dirname(HERE), HERE]

from changelens.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("changelens-tests", cores=4)
    yield session
    session.stop()
