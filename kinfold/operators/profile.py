"""Profiles of sources and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import extract as X


def file_profile(named: dict[str, DataFrame | None]) -> DataFrame:
    """(file, present, rows) of each source; None is a missing file."""
    spark = next(d for d in named.values() if d is not None).sparkSession
    out = None
    for name, df in named.items():
        row = spark.createDataFrame([(name, False, 0)], "file string, present boolean, rows long") if df is None else df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("file"), F.lit(True).alias("present"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def file_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(file, bytes) of files or folders of parts, asked of the file system that each lies in; null where there is none."""
    rows = []
    for name, path in paths.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        rows.append((name, fs.getContentSummary(p).getLength() if fs.exists(p) else None))
    return spark.createDataFrame(rows, "file string, bytes long")


def truth_profile(lists: DataFrame) -> DataFrame:
    """(matches, entities, percent): how many queries have how many partners."""
    n = lists.groupBy(F.size("matches").cast("long").alias("matches")).agg(F.count("*").alias("entities"))
    total = lists.agg(F.count("*").alias("total"))
    return n.crossJoin(total).select("matches", "entities", F.round(100 * F.col("entities") / F.col("total"), 2).alias("percent"))


def truth_summary(lists: DataFrame) -> DataFrame:
    """(entities, singletons, matched, most)."""
    n = F.size("matches")
    return lists.agg(F.count("*").alias("entities"), F.count(F.when(n == 0, 1)).alias("singletons"), F.count(F.when(n > 0, 1)).alias("matched"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("most"))


def conflicts(pairs: DataFrame) -> DataFrame:
    """(t, queries): targets that are matched with more than one query."""
    return pairs.select("s1", "t").distinct().groupBy("t").agg(F.count("*").alias("queries")).filter("queries > 1")


def countries(records: DataFrame, most: int = 12) -> DataFrame:
    """(country, records) of the most frequent labels, '<EMPTY>' for none."""
    c = F.trim(F.coalesce("country", F.lit("")))
    return records.groupBy(F.when(c == "", "<EMPTY>").otherwise(c).alias("country")).agg(F.count("*").alias("records")).orderBy(F.desc("records"), "country").limit(most)


def scripts(records: DataFrame) -> DataFrame:
    """(names, indic, latin_ext): names, and how many are partly in Indic or accented Latin script."""
    name = F.coalesce("business_name", F.lit(""))
    d = records.filter(name != "")
    return d.agg(F.count("*").alias("names"), F.count(F.when(X.script_share(F.col("business_name"), "indic") > 0.1, 1)).alias("indic"), F.count(F.when(X.script_share(F.col("business_name"), "latin_ext") > 0.05, 1)).alias("latin_ext"))


def exact_copies(records: DataFrame) -> DataFrame:
    """(records, copies): rows, and those that another row equals in name, address and country."""
    n = records.groupBy("business_name", "business_address", "country").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("copies"))
