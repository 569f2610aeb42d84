import subprocess
import sys


def test_registered_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 90; print(len(q))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).returncode == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
