import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} <= set(entry.queries()) or not (ROOT / "coppice" / "llm").exists()


def test_the_core_does_not_import_the_subpackage():
    for file in (ROOT / "coppice").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "coppice.llm" not in file.read_text(), file


def test_the_core_works_without_the_subpackage():
    code = "import sys; sys.modules['coppice.llm'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; assert len(e.queries()) > 60" % str(ROOT)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_entry(spark):
    if Path("/root/testdata/sf0.001").exists():
        assert entry.entry(spark).count() == 1
