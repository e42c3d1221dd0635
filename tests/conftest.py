"""One local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from siltstone.session import local_session  # noqa: E402
from siltstone.sources.tables import TABLES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    """A value that both engines give alike: lists, no numpy, floats to nine digits."""
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}") + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, duck, query, sql):
    df = query(spark, SF_DIR)
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not different, different[:3]
