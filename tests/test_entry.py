"""The entry point without the operators on texts, or without what these need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("lacking", ["xxhash", "receivables.llm"])
def test_entry_registers_the_report_alone(lacking):
    code = (
        f"import sys; sys.modules['{lacking}'] = None\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'ageing_report' in names and 'pipeline' not in names, names\n"
        "assert set(e.oracle_sql()) == names, set(e.oracle_sql()) ^ names\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
