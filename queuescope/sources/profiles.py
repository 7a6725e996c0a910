"""Function profile documents."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuescope import vocab


def read_profile(spark: SparkSession, path: str) -> DataFrame | None:
    """Profile documents at ``path``; None where there is no such file. Text that is no JSON fails."""
    options = {"multiLine": "true", "mode": "FAILFAST"}
    try:
        return spark.read.schema(vocab.PROFILE_DOCUMENT).options(**options).json(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def parse_profiles(documents: DataFrame, text: str) -> DataFrame:
    """Parse a column of profile JSON texts. Text that is no JSON fails."""
    parsed = F.from_json(F.col(text), vocab.PROFILE_DOCUMENT, {"mode": "FAILFAST"})
    return documents.select(parsed["data"].alias("data"))
