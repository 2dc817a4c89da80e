"""Python workers need no copy of the library: all queries from a folder that is not the repository's."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from fraudloom.session import build_session
spark = build_session("bare", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
found = spark.range(1).mapInPandas(lambda b: (x.assign(id=int(__import__("importlib.util").util.find_spec("fraudloom") is not None)) for x in b), "id long")
assert found.first()[0] == 0, "the workers can import the package"
for name, run in entry.queries().items():
    if name == "pipeline" or name.startswith("op") and name[2].isdigit():
        print(name, run(spark, sys.argv[2]).count(), flush=True)
"""


def test_workers_need_no_copy_of_the_library(tmp_path, sf_dir):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, sf_dir], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=1500)
    assert done.returncode == 0, done.stdout[-500:] + done.stderr[-3000:]
    assert len(done.stdout.split("\n")) >= 15
