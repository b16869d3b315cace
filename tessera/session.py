"""Session helpers.

Operators never build a session themselves; they take DataFrames. These
helpers exist for tests, the bench and the driver contract, and for the
few operators that must cut lineage (they read ``spark.checkpoint.dir``
from the session instead of picking a local folder).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every session of this library should have. Shuffle partitions
# are left to the caller on a cluster; AQE coalesces small ones and splits
# skewed join partitions at run time.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """Session for tests and the bench (local mode)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.driver.memory", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """One JVM (``local``, ``local[n]``); ``local-cluster[..]`` has several."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it this raises, as executors would not see each other's
    files. Only a local master gets a scratch folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not is_local(sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)      # a folder of this process only
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some deployments refuse core settings at run time
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for written intermediate
    tables; all of an application lie in one folder, see ``release_scratch``."""
    return f"{_scratch_root(spark)}/{name}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def release_scratch(spark: SparkSession) -> bool:
    """Deletes every intermediate table that this application has written.
    For the caller to run once it has written the results that read them;
    goes through the store's own file system, so any shared store will do."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return bool(path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True))
