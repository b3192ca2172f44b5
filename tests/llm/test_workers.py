"""Every query runs where the Python workers cannot import this package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from usagelake.session import build_session
import __spark_entry__ as entry

spark = build_session("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
spark.sparkContext.setLogLevel("OFF")

def probe(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("usagelake") is None])], names=["missing"])

assert spark.range(1).mapInArrow(probe, "missing boolean").head().missing
for name, query in entry.LLM_QUERIES.items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
"""


def test_queries_run_without_the_package_on_workers(tmp_path):
    script = tmp_path / "driver.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, str(script), ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stderr[-3000:]
    assert got.stdout.count("ran ") == 14
