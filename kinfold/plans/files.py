"""Queries that write the records to files as users bring them, and read them back: sources, sinks, validators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import profile as A
from kinfold.operators import validate as V
from kinfold.plans.registry import chained, query
from kinfold.plans.views import RECORDS_SQL, TRUTH_SQL, records, sides, truth
from kinfold.sources import records as SRC
from kinfold.sources import sinks as K
from kinfold.sources.shared import fresh_folder

#: The records as files hold them: no tabs in fields, and an empty field for a null.
FLAT_SQL = r"""flat AS (SELECT entity_id, regexp_replace(business_name, '[\t\r]', ' ', 'g') AS business_name, regexp_replace(coalesce(business_address, ''), '[\t\r]', ' ', 'g') AS business_address, country FROM rec)"""


def flat(spark, sf_dir: str) -> DataFrame:
    d = records(spark, sf_dir)
    return d.select(*[F.regexp_replace(F.coalesce(c, F.lit("")), "[\\t\\r]", " ").alias(c) for c in SRC.RECORD])


def lines(df: DataFrame, line, header: str, path: str) -> str:
    """Lines as they are under a header, whatever tabs they have."""
    df.select(line.alias(header)).write.csv(path, sep="\u0001", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("er_ragged_tsv", chained(RECORDS_SQL, FLAT_SQL) + " SELECT entity_id, business_name, CASE length(entity_id) % 3 WHEN 1 THEN '' ELSE business_address END AS business_address, CASE length(entity_id) % 3 WHEN 1 THEN '' ELSE country END AS country FROM flat")
def er_ragged_tsv(spark, sf_dir):
    """Rows of too few and too many fields under other headers, read tolerantly."""
    d = flat(spark, sf_dir)
    n = F.length("entity_id") % 3
    whole = F.concat_ws("\t", *SRC.RECORD)
    line = F.when(n == 1, F.concat_ws("\t", "entity_id", "business_name")).when(n == 2, F.concat(whole, F.lit("\tmore\tand more"))).otherwise(whole)
    path = lines(d, line, "source2_entity_id\tname\taddress\tcountry", f"{fresh_folder(spark)}/ragged.tsv")
    return SRC.canonical(SRC.read_tolerant(spark, path)).select(*SRC.RECORD)


@query("er_renamed_headers", chained(RECORDS_SQL, FLAT_SQL) + " SELECT entity_id, business_name, '' AS business_address, country FROM flat")
def er_renamed_headers(spark, sf_dir):
    """Columns found by parts of their headers, in another order; one is missing."""
    path = f"{fresh_folder(spark)}/other.tsv"
    K.write_tsv(flat(spark, sf_dir).select(F.col("country").alias("Country code"), F.col("business_name").alias("Trade Name"), F.col("entity_id").alias("record_id")), path)
    return SRC.by_header_part(SRC.read_tolerant(spark, path))


@query("er_two_catalogues", chained(RECORDS_SQL, FLAT_SQL) + " SELECT entity_id, business_name, business_address, country FROM flat WHERE NOT starts_with(entity_id, 'S1-')")
def er_two_catalogues(spark, sf_dir):
    """Two target files of a split, found in its folder, and one that is not there, as one table."""
    _, t = sides(flat(spark, sf_dir))
    folder = fresh_folder(spark)
    for k in (2, 3):
        K.write_tsv(t.filter(F.startswith("entity_id", F.lit(f"S{k}-"))), f"{folder}/test/test_source{k}.tsv")
    return SRC.catalogue(*[SRC.read_if_there(spark, SRC.find_file(spark, folder, f"test_source{k}.tsv")) for k in (2, 3, 4)])


@query("er_source_ids", chained(RECORDS_SQL) + " SELECT DISTINCT entity_id FROM rec")
def er_source_ids(spark, sf_dir):
    """The ids of a file under a header of its own, repeated and padded rows included."""
    d = flat(spark, sf_dir).select("business_name", F.explode(F.array(F.col("entity_id"), F.concat(F.lit(" "), "entity_id"), F.lit(" "))).alias("source1_entity_id"))
    path = f"{fresh_folder(spark)}/ids.tsv"
    K.write_tsv(d, path)
    return SRC.read_ids(SRC.read_tsv(spark, path))


@query("er_stored_country", chained(RECORDS_SQL) + " SELECT entity_id, business_name FROM rec WHERE country = 'France'")
def er_stored_country(spark, sf_dir):
    """A table stored by country, of which one partition and two columns are read."""
    path = f"{fresh_folder(spark)}/records"
    K.write_table(records(spark, sf_dir), path, "country")
    return SRC.read_parquet(spark, path, ["entity_id", "business_name", "country"], "France").select("entity_id", "business_name")


@query("er_truth_file", chained(RECORDS_SQL, TRUTH_SQL) + " SELECT entity_id AS s1, array_to_string(coalesce(list_sort(list(g.t) FILTER (g.t IS NOT NULL)), []), ',') AS matches FROM rec LEFT JOIN truth g ON g.s1 = entity_id WHERE starts_with(entity_id, 'S1-') GROUP BY entity_id")
def er_truth_file(spark, sf_dir):
    """Ground truth written as lists with spaces and empty items, and read again."""
    d = records(spark, sf_dir)
    lists = K.id_lists(sides(d)[0], truth(d)).withColumn("matched_entity_ids", F.concat(F.lit(" "), F.replace("matched_entity_ids", F.lit(","), F.lit(" ,, ")), F.lit(",")))
    path = f"{fresh_folder(spark)}/truth.tsv"
    K.write_tsv(lists, path)
    return SRC.truth_lists(SRC.read_tsv(spark, path)).select("s1", F.array_join("matches", ",").alias("matches"))


@query("er_file_sizes", chained(RECORDS_SQL) + " SELECT 'ids' AS file, sum(octet_length(encode(entity_id)) + 1)::BIGINT AS bytes FROM rec UNION ALL SELECT 'none', NULL")
def er_file_sizes(spark, sf_dir):
    """Bytes of a file in parts, and of one that is not there."""
    folder = fresh_folder(spark)
    records(spark, sf_dir).select("entity_id").write.text(f"{folder}/ids")
    return A.file_sizes(spark, {"ids": f"{folder}/ids", "none": f"{folder}/none"})


# --- validators over files --------------------------------------------------------------------------

_HEAD = "source1_entity_id\tmatched_entity_ids"


def _files(spark, sf_dir: str, folder: str) -> dict[str, str]:
    """A catalogue, right candidates, and match lists with faults: a line without tab, a header twice, a match that is no candidate."""
    d = flat(spark, sf_dir)
    s1, t = sides(d)
    out = {k: f"{folder}/{k}.tsv" for k in ("source1", "source2", "source3", "matching", "candidates")}
    K.write_tsv(s1, out["source1"])
    for k in (2, 3):
        K.write_tsv(t.filter(F.startswith("entity_id", F.lit(f"S{k}-"))), out[f"source{k}"])
    lists = K.id_lists(s1, truth(records(spark, sf_dir)))
    K.write_tsv(lists.withColumnRenamed("matched_entity_ids", "candidate_entity_ids"), out["candidates"])
    n = F.length("source1_entity_id") % 5
    line = F.when(n == 0, F.col("source1_entity_id")).when(n == 1, F.concat("source1_entity_id", F.lit("\tS2-none"))).when(n == 2, F.concat("source1_entity_id", F.lit("\t"), "source1_entity_id")).otherwise(F.concat_ws("\t", "source1_entity_id", "matched_entity_ids"))
    again = spark.range(1).select(F.lit(_HEAD).alias("x"))
    lines(lists.select(line.alias("x")).unionByName(again), F.col("x"), _HEAD, out["matching"])
    return out


_FILES_SQL = f"""need AS (SELECT entity_id AS s1, length(entity_id) % 5 AS n FROM rec WHERE starts_with(entity_id, 'S1-')),
fnd AS (SELECT 'no_tab' AS rule, 'error' AS severity, s1 AS x FROM need WHERE n = 0 UNION ALL SELECT 'missing_row', 'error', s1 FROM need WHERE n = 0 UNION ALL SELECT 'unknown_row', 'error', 'source1_entity_id' UNION ALL {{}})
SELECT 'matching' AS file, rule, severity, count(DISTINCT x)::BIGINT AS n_offenders, array_to_string(list_sort(list(DISTINCT x))[1:5], ',') AS examples FROM fnd GROUP BY rule, severity"""
_PLAIN_FAULTS = "SELECT 'unknown_id', 'error', 'S2-none' FROM need WHERE n = 1 UNION ALL SELECT 'self_match', 'error', s1 FROM need WHERE n = 2 UNION ALL SELECT 'wrong_prefix', 'error', 'matched_entity_ids'"
_OUTSIDE = "SELECT 'not_a_candidate', '{}', s1 FROM need WHERE n IN (1, 2) UNION ALL SELECT 'not_a_candidate', '{}', 'source1_entity_id'"


def _validated(spark, sf_dir: str, strict: bool) -> DataFrame:
    f = _files(spark, sf_dir, fresh_folder(spark))
    found = V.validate(spark, f["matching"], f["candidates"], f["source1"], (f["source2"], f["source3"]), strict=strict)
    return found.withColumn("examples", F.array_join("examples", ","))


@query("er_validate_files", chained(RECORDS_SQL, _FILES_SQL.format(f"{_PLAIN_FAULTS} UNION ALL {_OUTSIDE.format('warning', 'warning')}")))
def er_validate_files(spark, sf_dir):
    """The whole check of a broken match file against its candidates and sources."""
    return _validated(spark, sf_dir, False)


@query("er_validate_strict", chained(RECORDS_SQL, _FILES_SQL.format(_OUTSIDE.format("error", "error"))))
def er_validate_strict(spark, sf_dir):
    """The same, strictly: matches must be candidates, and prefixes and known ids are asked of these alone."""
    return _validated(spark, sf_dir, True)


@query("er_validate_broken", "SELECT * FROM (VALUES ('matching', 'header', 'error', 1::BIGINT, 'a' || chr(9) || 'b'), ('matching', 'comma_separated', 'error', 1, 'a,b'), ('matching', 'no_file', 'error', 1, 'gone.tsv'), ('candidate', 'no_file', 'warning', 1, 'gone.tsv')) v(file, rule, severity, n_offenders, examples)")
def er_validate_broken(spark, sf_dir):
    """Files that cannot be read at all: a wrong header, commas, none."""
    folder = fresh_folder(spark)
    s1 = sides(records(spark, sf_dir))[0]
    K.write_tsv(s1.select("entity_id"), f"{folder}/source1.tsv")
    one = spark.range(1).select(F.lit("x\ty").alias("x"))
    paths = [lines(one, F.col("x"), head, f"{folder}/{name}.tsv") for name, head in (("tabs", "a\tb"), ("commas", "a,b"))]
    out = [V.validate(spark, p, None, f"{folder}/source1.tsv") for p in paths] + [V.validate(spark, f"{folder}/gone.tsv", f"{folder}/gone.tsv", f"{folder}/source1.tsv")]
    found = out[0].unionByName(out[1]).unionByName(out[2])
    return found.withColumn("examples", F.replace(F.array_join("examples", ","), F.lit(f"{folder}/"), F.lit("")))
