"""Lists of known objects and interfaces: one name per line, in two dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wallflow.functions.text import strip_ws
from wallflow.sources.listing import escaped, list_files, newest_file

# How a line states a name.
OBJECT_NAME = 'name="([^"]+)"'
INTERFACE_IFNAME = '(?U)ifname=("[^"]+"|\\S+)'
INTERFACE_NAME = 'Name="([^"]+)"'


def _captured(line: Column, pattern: str) -> Column:
    """First capture of the pattern, null when it does not occur."""
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def object_names(lines: DataFrame) -> DataFrame:
    """Distinct ``name`` from the ``value`` lines of an object list."""
    line = strip_ws(F.col("value"))
    bare = F.when((line != "") & ~line.startswith("#"), line)
    return lines.select(F.coalesce(_captured(F.col("value"), OBJECT_NAME), bare).alias("name")).dropna().distinct()


def interface_names(lines: DataFrame) -> DataFrame:
    """Distinct ``name`` from the ``value`` lines of an interface list."""
    line = strip_ws(F.col("value"))
    bare = F.when((line != "") & ~line.rlike("^[#\\[]") & ~line.contains("="), line)
    ifname = F.btrim(_captured(line, INTERFACE_IFNAME), F.lit('"'))
    return lines.select(F.coalesce(ifname, _captured(line, INTERFACE_NAME), bare).alias("name")).dropna().distinct()


def _lines(spark: SparkSession, path: str | None) -> DataFrame:
    if path and list_files(spark, path) is not None:
        return spark.read.text(escaped(path))
    return spark.createDataFrame([], "value string")


def read_objects(spark: SparkSession, path: str | None) -> DataFrame:
    """Names of an object list; none when the file does not exist."""
    return object_names(_lines(spark, path))


def read_interfaces(spark: SparkSession, path: str | None) -> DataFrame:
    """Names of an interface list; none when the file does not exist."""
    return interface_names(_lines(spark, path))


def newest_lists(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The latest object list and the latest interface list of a folder."""
    return newest_file(spark, folder, "objects"), newest_file(spark, folder, "interfaces")
