import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"p1_found", "p3_found", "p4_found", "p5_found"} <= set(q)
    if (ROOT / "pepspark" / "llm" / "queries.py").exists():
        assert {"p6_ids", "p7_found", "p8_found"} <= set(q)


def test_the_rest_stands_without_llm():
    for p in [*ROOT.glob("*.py"), *(ROOT / "pepspark").rglob("*.py")]:
        inside = "llm" in p.relative_to(ROOT).parts
        if not inside and p.name != "__spark_entry__.py":
            assert not re.search(r"^\s*(?:from|import) .*\bllm\b", p.read_text(), re.M), p
    code = "import sys; sys.modules['pepspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p6_ids' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["peptide", "n", "mass", "mz2", "gravy"] and df.count() == 100


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_scans_read_only_needed_columns(spark):
    import __spark_entry__ as e

    def schema(name):
        plan = e.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        return " ".join(re.findall(r"ReadSchema: \S+", plan))

    assert "mz:array" not in schema("p4_charges") and "charge" in schema("p4_charges")
    assert "text" not in schema("p3_found")
