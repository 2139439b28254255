from __future__ import annotations

import os

import pytest

# Python workers import the package from here.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """The session, with a folder for written steps if it has none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))
    return spark


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars int"):
    return spark.createDataFrame(rows, schema)


#: Nulls, empty and odd texts, ties, repeated rows and a very long text.
ODD = [
    (1, "the same line of words here\nonly one here\n odd space line ", "en", "src0", 1),
    (2, " THE SAME line of words here \t\nanother one", "en", "src0", 2),
    (2, " THE SAME line of words here \t\nanother one", "en", "src0", 2),
    (3, None, None, None, None),
    (4, "", "en", "src1", 0),
    (5, "\n\n", "en", "src1", 2),
    (6, "word " * 30_000, "en", "src2", 150_000),
    (7, "x" * 40_000, "en", "src2", 40_000),
    (None, "the same line of words here", "en", "src0", 3),
    (8, 'kéy token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" <|endoftext|> \U0001F600 password:12345 token=token:abcdefgh', "en", "src1", 9),
]
