"""Session-level helpers: the shared folder for intermediate tables, and lineage cuts."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, by default the one that ``spark.checkpoint.dir`` names.

    Executors read each other's files there, so on a cluster it must be a shared folder and is never
    made up. In local mode, where one machine is all there is, a temporary folder stands in.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="queuescope-checkpoint-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there.

    Spark removes the files with the DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
