"""The driver contract, with and without the llm folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "sparkyard", tmp_path / "sparkyard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(k.startswith('op') for k in q if k[2:3].isdigit()) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 3 and all(r.total_lots > 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["overlap_windows", "assemble_text", "tukey_bounds", "sanity_repair", "burst_guard", "compare", "parse_responses", "notes_inference", "ocr_documents", "document_arrays", "verdict_application", "extracted_lots", "batch_markdown"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, folder)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    plain = lambda rows: sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(map(tuple, got.select(*order).collect())) == plain(want.select(*(f'"{c}"' for c in order)).fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_engine_plans_stay_in_the_jvm(spark):
    """No Python in any plan of the engine's operators, no range joins, columns pruned at the scan."""
    from sparkyard.plans import registry

    for name, query in registry.queries().items():
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow")), name
        if name not in ("run_grid", "batch_markdown"):  # two lists of names; parts of a report, a row each
            assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
    plan = registry.queries()["tukey_bounds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in plan and "GreaterThan(l_extendedprice" in plan
