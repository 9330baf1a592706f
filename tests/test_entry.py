import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_every_query_is_called_and_sql_belongs_to_one():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(map(callable, entry.queries().values()))


def test_reads_without_the_llm_folders():
    """The rest of the library doesn't import them."""
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
import importlib.util as u
real = u.find_spec
u.find_spec = lambda n, *a: None if n.startswith(("tessella.llm", "corpus_pipeline")) else real(n, *a)
import __spark_entry__ as e
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert not any(n.startswith("tessella.llm") for n in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=REPO)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"event_type", "n_rows", "n_valid", "n_invalid"}


@pytest.mark.skipif(importlib.util.find_spec("duckdb") is None or not Path("/root/testdata/sf0.001").exists(), reason="needs duckdb and the driver's tables")
@pytest.mark.parametrize("name", ["loads_embedded_json", "loads_yaml_prose", "validate_range", "validate_error_messages", "render_yaml_tables", "schema_fields", "compare_tokens", "adapter_parse_completion"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted((tuple(dict(zip(want.columns, r, strict=True))[c] for c in cols) for r in want.fetchall()), key=repr)
