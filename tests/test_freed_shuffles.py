"""Shuffle files go with the step that made them."""

import subprocess
import sys
import textwrap

import pytest


@pytest.mark.parametrize("writer", ["Scratch(spark).materialize", "Store(spark).write"])
def test_shuffles_of_a_written_table_are_deleted(tmp_path, writer):
    """In a session of its own, whose local folder can be looked into."""
    code = f"""
        import os
        from pyspark.sql import functions as F
        from landsieve import Scratch, build_session
        from landsieve.llm.store import Store
        from landsieve.session import CLEANUP
        spark = build_session("t", "local[2]", **{{"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.local.dir": {str(tmp_path / 'local')!r},
            "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {str(tmp_path / 'shared')!r}, "spark.cleaner.referenceTracking": "false"}})
        rows = spark.range(20000).groupBy(F.col("id") % 7000).count()
        kept = {writer}(rows, "rows")
        files = [f for _, _, names in os.walk({str(tmp_path / 'local')!r}) for f in names if f.startswith("shuffle")]
        print("left", len(files), kept.count(), spark.conf.get(CLEANUP))
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=120)
    assert "left 0 7000 false" in run.stdout, run.stderr[-800:]
