"""Session settings and the reliable checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows for which a checkpoint gets a file.
FILE_ROWS = 1 << 15


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("postmill")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``DataFrame.checkpoint``.

    The shared folder named by ``spark.checkpoint.dir`` wins. Only a session
    that names none (tests, a laptop) gets a folder of its own, and only with a
    local master: executors on other machines could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    target = shared or tempfile.mkdtemp(prefix="postmill-checkpoint-")
    sc.setCheckpointDir(target)
    return target


def compact_checkpoint(frame: DataFrame, rows: int) -> DataFrame:
    """``frame`` on a checkpoint, in a file for each FILE_ROWS of about ``rows`` rows, and in no more files than ``frame`` has partitions.

    Each file of a checkpoint makes its executor start two processes where Hadoop's native library is missing (chmod of the file and of its
    checksum), so small tables should not have as many files as shuffles have partitions.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.coalesce(max(1, -(-rows // FILE_ROWS))).checkpoint()
