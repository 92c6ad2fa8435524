"""Every registered query has its SQL, and SQL only registered queries; nothing outside llm imports it."""

import pathlib
import re

import __spark_entry__
from banstream.plans import queries, streams
from banstream.plans.sql import SQL

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_keys():
    assert set(SQL) == set(queries.QUERIES) | set(streams.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_llm_stands_alone():
    for path in (ROOT / "banstream").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"banstream\.llm|corpus_pipeline", path.read_text()), path


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 30
