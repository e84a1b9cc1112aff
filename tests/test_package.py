"""The archive sent to executors can be imported with nothing else on the path."""
import os
import subprocess
import sys

from shroud.session import package_archive


def test_archive_imports_alone(tmp_path):
    archive = package_archive(str(tmp_path))
    code = f"import sys; sys.path.insert(0, {archive!r}); import shroud.functions.kernel as k, shroud.functions.patterns; print(k.__file__)"
    bare = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONHOME")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=bare, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.startswith(archive)


QUERY = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
sys.path.remove({root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print(E.queries()["c1_pii_type_counts"](spark, "/root/testdata/sf0.001").count())
"""


def test_query_from_elsewhere(tmp_path):
    """Workers that don't see the source folder get the package from the archive."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    bare = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONHOME")}
    out = subprocess.run([sys.executable, "-c", QUERY.format(root=root)], cwd=tmp_path, env=bare, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) > 0
