"""Sources: record files, ground truth, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("entity_id", "business_name", "business_address", "country")
#: Headers that name the same column.
ALIASES = {
    "id": "entity_id", "source1_entity_id": "entity_id", "source2_entity_id": "entity_id", "source3_entity_id": "entity_id", "name": "business_name", "address": "business_address",
}


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text with a header: no quoting, every column a string, an empty field a null."""
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False, mode="PERMISSIVE")


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """The same; blank lines are skipped, short rows filled up, long ones cut, and nulls are empty texts."""
    return read_tsv(spark, path).na.fill("")


def canonical(df: DataFrame) -> DataFrame:
    """Known headers under their one name each."""
    taken = set(df.columns)
    return df.withColumnsRenamed({c: ALIASES[c] for c in df.columns if c in ALIASES and ALIASES[c] not in taken})


def by_header_part(df: DataFrame) -> DataFrame:
    """Record columns found by a part of their header; missing ones are empty."""
    find = {"entity_id": ("id",), "business_name": ("name",), "business_address": ("addr",), "country": ("country",)}
    out, used = [], set()
    for name, parts in find.items():
        hit = next((c for c in df.columns if c == name), None) or next((c for c in df.columns if c not in used and any(p in c.lower() for p in parts)), None)
        used.add(hit)
        out.append((F.col(f"`{hit}`") if hit else F.lit("")).alias(name))
    return df.select(*out)


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system the path belongs to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_if_there(spark: SparkSession, path: str) -> DataFrame:
    """A record file, or no rows where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in RECORD]))
    return canonical(read_tolerant(spark, path))


def find_file(spark: SparkSession, folder: str, name: str) -> str:
    """A split's file: in the folder itself, or in its train or test folder."""
    options = [f"{folder}/{name}", *(f"{folder}/{s}/{name}" for s in ("train", "test") if name.startswith(s)), *(f"{folder}/{s}/{name}" for s in ("train", "test"))]
    return next((p for p in options if exists(spark, p)), options[0])


def truth_lists(df: DataFrame) -> DataFrame:
    """(s1, matches): items trimmed, empty ones dropped; headers in either style."""
    own = df.columns
    items = F.filter(F.transform(F.split(F.coalesce(F.col(own[1]), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.trim(F.col(own[0])).alias("s1"), items.alias("matches"))


def truth_pairs(truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(s1, t, c1): true pairs whose records are there."""
    long = truth_lists(truth).select("s1", F.explode("matches").alias("t")).distinct()
    return long.join(s1.select(F.col("entity_id").alias("s1"), F.col("country").alias("c1")), "s1").join(targets.select(F.col("entity_id").alias("t")), "t", "left_semi").select("s1", "t", "c1")


def read_ids(df: DataFrame) -> DataFrame:
    """The distinct ids of a file: the column that is named for it, or the first."""
    named = next((c for c in df.columns if c.endswith("entity_id") or c == "id"), df.columns[0])
    return df.select(F.trim(F.col(f"`{named}`")).alias("entity_id")).filter("entity_id <> ''").distinct()


def catalogue(*sources: DataFrame) -> DataFrame:
    """All targets in one table."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_parquet(spark: SparkSession, path: str, columns: list[str], country: str | None = None) -> DataFrame:
    """Columns of a stored table, of one country; both reach the scan."""
    df = spark.read.parquet(path).select(*columns)
    return df if country is None else df.filter(F.col("country") == country)
