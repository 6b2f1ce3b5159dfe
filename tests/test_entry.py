import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_own_queries_stay_where_an_import_is_missing():
    code = "import sys; sys.modules['ahocorasick'] = sys.modules['zstandard'] = None\nimport __spark_entry__ as e\nq, s = e.queries(), e.oracle_sql()\nprint(len(q), 'chat_answers' in q, any(x.startswith('op') and x[2].isdigit() for x in q), 'pipeline' in q, set(s) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1:] == ["True", "False", "False", "True"]


def test_scratch_folder_is_shared_or_refused(spark):
    from quillon import scratch

    class Cluster:
        master = "yarn"
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext = Cluster
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        try:
            scratch.scratch_dir(Session)
        except ValueError as e:
            assert "spark.checkpoint.dir" in str(e)
        else:
            raise AssertionError
    assert scratch.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
