from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rollcall.session import local_session

    return local_session(cores=4, shuffle_partitions=4, app="rollcall-llm-tests")


def documents(spark: SparkSession, rows):
    """Documents table of (doc_id, text) with an extra column whose name may clash."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, start string")


#: Texts that every operator has to stand: null, empty, white space, one word, very
#: long, repeated.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "long " * 30_000), (6, "a b c d e f g"), (7, "a b c d e f g"), (8, "é ü 😀 x" * 9)]
