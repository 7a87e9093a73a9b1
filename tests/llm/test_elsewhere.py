"""Tasks run without a copy of this package: all they need is sent along."""

import os
import subprocess
import sys

import pytest

from foliant.llm import url_rules

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {folder!r}).getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def seen(_):
    try:
        import foliant
    except ImportError:
        return [False]
    return [True]

assert spark.sparkContext.parallelize([1], 1).mapPartitions(seen).collect() == [False], "workers see the package"
from foliant.llm.queries import QUERIES
for name in {names!r}:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""
NAMES = ["op1_syncmers", "op2_url_rules", "op4_partition_search", "op5_pieces", "op7_licences", "op8_toxicity",
         "op11_alignment", "op12_conversation_repair", "op13_language_id"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT, folder=str(tmp_path / "shared"), names=NAMES))
    settings = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=settings, capture_output=True, text=True,
                          timeout=600)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == NAMES


def test_a_long_segment_is_tried_at_the_lengths_of_rules_alone():
    trie = url_rules.Trie([("block", "a.org", "/x" + "y" * 50), ("allow", "a.org", "/x"), ("block", "a.org", "/")])
    assert trie.find("a.org", "/x" + "y" * 2_000_000) == ("a.org/x" + "y" * 50, "block")
    assert trie.find("a.org", "/x" + "y" * 49) == ("a.org/x", "allow")
    assert trie.find("b.a.org", "/" + "z" * 2_000_000) == ("a.org/", "block")
