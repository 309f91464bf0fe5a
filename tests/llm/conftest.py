from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(os.path.dirname(HERE))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session", autouse=True)
def _workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
