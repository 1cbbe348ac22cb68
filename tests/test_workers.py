"""Every registered query that hands Python code to workers runs when the job is started in another folder and the package is
not on the workers' path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
QUERIES = ["anomaly_iforest", "anomaly_lof", "lag_corr_kendall", "dmdc_one_step", "dmdc_simulate", "forecast_horizon", "lag_sweep_pcr", "lag_sweep_hidden", "multi_lag_sweep"]
JOB = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spark.range(1).mapInPandas(lambda b: b, "id long").collect()  # workers start before the package is known
sys.path.insert(0, sys.argv[1])
from lagwise.plans.queries import REGISTRY
for name in sys.argv[2:]:
    print(name, REGISTRY[name](spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", JOB, ROOT, *QUERIES], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert [x for x in out.stdout.splitlines() if x.endswith(" True")] == [f"{q} True" for q in QUERIES]
