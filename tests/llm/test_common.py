"""Stored steps and their end."""

import os

from changelens.llm import common


def test_release(spark):
    made = common.stored(spark.range(5), "step")
    assert made.count() == 5
    folder = common._MADE[-1].removeprefix("file:").replace("//", "/")
    assert os.path.isdir(folder)
    assert common.release(spark) >= 1
    assert not os.path.isdir(folder) and common._MADE == []
