"""The command line lists every registered query."""

import subprocess
import sys

import __spark_entry__ as E


def test_cli_lists_all_queries():
    out = subprocess.run([sys.executable, "-m", "ascribe", "list"], capture_output=True, text=True,
                         cwd=__import__("os").path.dirname(E.__file__), timeout=120).stdout
    listed = {line.split()[0] for line in out.splitlines() if line.strip()}
    from ascribe import plans
    assert listed == set(plans.QUERIES) <= set(E.queries())
