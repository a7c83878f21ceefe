"""Extension-host log files as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE

C = F.col

# Folders whose logs are read - the assistant's own and those of extension hosts -, terminal logs anywhere,
# and the session directory in a path.
PATH_PATTERN = r"(?i)/([^/]*github\.copilot[^/]*|exthost\d*)/.*\.log$|/[^/]*(exthost\d*|terminal)[^/]*\.log$"
SESSION_PATTERN = r"/(\d{8}T\d{6})[^/]*/"


def read_log_lines(
    spark: SparkSession, path: str, path_pattern: str = PATH_PATTERN, session_pattern: str = SESSION_PATTERN,
    files: str = "*.log",
) -> DataFrame:
    """Non-blank lines of the log files whose path matches, with session id, file and position. Files of any size are read,
    large ones in splits."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path)
    return raw.where(C("_metadata.file_path").rlike(path_pattern)).select(
        F.regexp_extract(C("_metadata.file_path"), session_pattern, 1).alias("session_id"),
        C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row"), C("value").alias("line"),
    ).where(C("line").rlike(f"[^{SPACE}]"))


def latest_sessions(lines: DataFrame, count: int) -> DataFrame:
    """Lines of the `count` newest sessions."""
    newest = lines.select("session_id").distinct().orderBy(C("session_id").desc()).limit(count)
    return lines.join(newest, "session_id", "left_semi")
