"""The entry module in a copy of the repository without the text-pipeline folders."""

import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinweave.functions import durable

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
found = e.queries()
assert "association_stats" in found and not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in found), sorted(found)
assert set(e.oracle_sql()) <= set(found)
"""


@pytest.mark.parametrize("gone", [("kinweave/llm", "corpus_pipeline.py"), ("kinweave/llm",)])
def test_entry_without_the_text_folders(tmp_path, gone):
    shutil.copytree(ROOT / "kinweave", tmp_path / "kinweave", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, timeout=120)


def test_durable_tables_can_be_released(spark):
    since = durable.mark()
    table = durable.durable(spark.range(10))
    assert table.count() == 10 and durable.mark() == since + 1
    folder = Path(table.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists()
    durable.release(since)
    assert not folder.exists() and durable.mark() == since


def test_a_written_table_leaves_no_shuffle_files(spark):
    local = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {x for x in local.rglob("shuffle_*.data")}
    before, was = files(), spark.conf.get(durable.SWEPT, "false")
    table = durable.durable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and table.count() == 7 and spark.conf.get(durable.SWEPT, "false") == was
