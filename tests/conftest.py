from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = os.environ.get("SYMTIDE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from symtide.session import local_session

    s = local_session(cores=8, shuffle=4, memory="6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture(scope="session")
def con(data):
    from tests.compare import duck

    return duck(data)


#: Column names that the operators use inside themselves.
CLASHES = ("s", "n", "id", "parent", "ptr", "label", "bucket", "depth", "root", "path", "side", "key", "made", "gone", "kept", "h", "r", "salt", "ref", "best", "eff_run", "was", "item", "pos", "items", "kind2", "template", "soft", "line_hash", "one", "words", "partner")


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use inside themselves."""
    from pyspark.sql import functions as F

    def add(df):
        for c in CLASHES:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    return add
