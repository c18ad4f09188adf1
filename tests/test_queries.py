"""Every query of the library against its DuckDB SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from touchline.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and v != v:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        return (2, f"{float(v):.5f}") if isinstance(v, int | float) or hasattr(v, "as_integer_ratio") else (3, str(v))

    return sorted([tuple(plain(r[i]) for i in order) for r in data])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert len(df.columns) == len(set(df.columns)) and got is not None
        return
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    a, b = rows(df.columns, got), rows(columns, want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for (k, u), (m, v) in zip(x, y, strict=True):
            assert k == m and (u == v or k == 2 and abs(float(u) - float(v)) <= 2e-5), (x, y)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:3] == ["league", "season", "team"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "touchline", tmp_path / "touchline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ladder_snapshot' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
