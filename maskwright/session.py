"""Session helpers: the shared work folder and the settings the jobs like."""

import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name="maskwright", master=None, conf=None):
    """A session with adaptive execution on; `conf` adds or overrides settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Many small files per task: with the default of 4 MB a task gets about 32.
        "spark.sql.files.openCostInBytes": str(OPEN_COST),
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of rows with texts or files that go to a Python worker at a time.
FILE_BATCH_BYTES = 1 << 22
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark):
    """From now on rows go to Python by their size too, not by their number alone: what workers
    hold does not grow with the input. The setting is read when a plan runs, so it stays. A
    smaller one of the session's own is kept."""
    conf = spark._jsparkSession.sessionState().conf()
    if conf.arrowMaxBytesPerBatch() > FILE_BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES_KEY, str(FILE_BATCH_BYTES))


#: What opening a small file counts as when files are dealt out to tasks: some 500 files each.
OPEN_COST = 256 * 1024


def few_tasks(spark):
    """From now on small files are read and looked up by tasks with many of them each. By default
    a task reads 32, and a stream looks up each of the up to 10,000 files of a batch again in a
    task of its own. Both settings are read when a batch runs, so they stay; smaller ones of the
    session's own are kept."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if int(spark.conf.get(key)) > tasks:
        spark.conf.set(key, str(tasks))
    if spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() > OPEN_COST:
        spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST))


_shipped = set()


def ship_packages(spark, root, packages):
    """Send packages below `root` to the Python workers, once per application."""
    for package in packages:
        mark = (spark.sparkContext.applicationId, package)
        if mark not in _shipped:
            base = os.path.join(tempfile.mkdtemp(prefix="ship-"), package)
            spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root_dir=root, base_dir=package))
            _shipped.add(mark)


def work_root(spark):
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder; on a
    cluster the setting is required, since executors share no local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="maskwright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_scope = contextvars.ContextVar("work_scope", default=None)


@contextlib.contextmanager
def work_scope(spark, name="job"):
    """What steps inside write for themselves goes to one folder, which is removed at the end of
    the `with` block, as it may hold personal data. It stays if the block fails. Results that
    are read later have to be written inside."""
    root = work_path(spark, name)
    token = _scope.set(root)
    try:
        yield root
    finally:
        _scope.reset(token)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def work_path(spark, name):
    """A fresh path below the shared folder, or below that of the job that runs."""
    return f"{(_scope.get() or work_root(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(spark, df, name):
    """Write `df` once to the shared folder and go on from the written table.

    Used where a step must not run twice (a model call) or must survive the loss
    of executors; the table stays until the job's `work_scope` ends or, without one, until
    the folder's owner clears it.
    """
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
