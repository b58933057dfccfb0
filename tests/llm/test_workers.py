import os
import subprocess
import sys
from pathlib import Path

import pytest

#: Two texts of the same words, of which seven in a row are in the same order: they meet, pass the bit sets, and aren't similar.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
SCRIPT = """
import sys
from pathlib import Path

from pyspark.sql import SparkSession

import corpus_pipeline

spark = (
    SparkSession.builder.master("local[1]")
    .config("spark.sql.shuffle.partitions", "2")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse")
    .config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/shared")
    .getOrCreate()
)
parent, daemons = {}, set()
docs = spark.sql("SELECT id AS doc_id, text, 'en' AS lang, 'src0' AS source, 1L AS n_chars FROM VALUES (1L, '%s'), (2L, '%s') AS t(id, text)")
stage = dict(corpus_pipeline.STAGES)[sys.argv[2]]
assert stage(spark, docs, sys.argv[1]).count() >= 2
for p in Path("/proc").iterdir():
    try:
        if p.name.isdigit():
            parent[int(p.name)] = int((p / "stat").read_text().rpartition(")")[2].split()[1])
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                daemons.add(int(p.name))
    except OSError:
        pass


def below(pid):
    return pid == spark.sparkContext._gateway.proc.pid or pid in parent and below(parent[pid])


print("processes", sum(below(p) for p in daemons))
spark.stop()
""" % (" ".join(WORDS), " ".join(WORDS[7:] + WORDS[:7]))


@pytest.mark.skipif(not Path("/proc/self/stat").exists(), reason="processes are counted in /proc")
@pytest.mark.parametrize("stage, processes", [("near_duplicates", 2), ("mixture", 0)])
def test_a_core_has_one_python_worker(tmp_path, stage, processes):
    """One core: no more than a daemon and a worker, though workers stay for the next task."""
    home = Path(__file__).parents[2]
    env = os.environ | {"PYTHONPATH": f"{home}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), stage], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert f"processes {processes}" in done.stdout.splitlines(), done.stdout + done.stderr[-2000:]
