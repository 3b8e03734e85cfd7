"""Intermediates: where they lie, and when they go."""

from __future__ import annotations

import os
import subprocess
import sys

from kgloom.session import own_path, saved, scratch, work_dir


def test_scopes_remove_what_is_not_kept(spark):
    with scratch(spark):
        outer = own_path(spark, "outer")
        spark.range(3).write.parquet(outer)
        with scratch(spark):
            saved(spark.range(2), "gone")
            kept = saved(spark.range(5), "kept", keep=True)
            names = {x.split("-")[0] for x in os.listdir(work_dir(spark).removeprefix("file://"))}
            assert {"outer", "gone", "kept"} <= names
        assert kept.count() == 5 and os.path.exists(outer)
        left = os.listdir(work_dir(spark))
        assert not any(x.startswith("gone") for x in left)
    left = os.listdir(work_dir(spark))
    assert not any(x.startswith(("outer", "kept")) for x in left)


def test_the_folder_goes_with_the_driver(tmp_path):
    script = (
        "from pyspark.sql import SparkSession\nfrom kgloom.session import saved, work_dir\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()\n"
        "saved(s.range(3), 'x').count()\nimport os\nassert os.listdir(work_dir(s))\ns.stop()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", script], check=True, timeout=120, cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True)
    # the virtual machine ends a moment after the driver
    for _ in range(50):
        if not any(x.startswith("kgloom") for x in os.listdir(tmp_path)):
            break
        subprocess.run(["sleep", "0.2"], check=True)
    assert not any(x.startswith("kgloom") for x in os.listdir(tmp_path))
