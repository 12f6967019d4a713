import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_is_a_callable_and_sql_names_one():
    from lodeworks.plans import catalog

    assert all(callable(q) for q in entry.queries().values())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_runs_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['lodeworks.llm'] = None; import __spark_entry__ as e; assert 'p4_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_the_library_does_not_import_it():
    for path in (ROOT / "lodeworks").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lodeworks.llm" not in path.read_text(), path
