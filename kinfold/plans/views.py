"""The driver's tables as business records.

Every line of every document is a record: its first five words are the name, the others, and a state
by the name's length, the address; the language is the country. Sources go round by document and line.
True pairs: a target and the first S1 record with the same name, address and country.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a line's language and the length of its name put for country and state.
LABELS = {"en": "US", "fr": "France", "es": "India"}
STATES = {
    "US": ("California", "TX", "New York", "West Virginia"),
    "India": ("Goa", "new delhi", "Tamil Nadu", "or"),
    "France": ("Nord", "Gironde", "Loire-Atlantique", "Pays de la Loire"),
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "s"))
    d = docs.withColumn("w", F.filter(F.split("s", "[ \\t\\r]+", -1), lambda x: x != "")).filter(F.size("w") > 0)
    country = F.col("lang")
    for k, v in LABELS.items():
        country = F.when(F.col("lang") == k, v).otherwise(country)
    d = d.select("doc_id", "line", F.array_join(F.slice("w", 1, 5), " ").alias("name"), F.array_join(F.slice(F.col("w"), F.lit(6), F.greatest(F.size("w") - 5, F.lit(0))), " ").alias("rest"), country.alias("country"))
    state = F.lit("")
    for k, own in STATES.items():
        state = F.when(F.col("country") == k, F.coalesce(F.get(F.array(*[F.lit(x) for x in own]), F.length("name") % 5), F.lit(""))).otherwise(state)
    address = F.when(state == "", F.when(F.col("rest") != "", F.col("rest"))).otherwise(F.concat("rest", F.lit(", "), state))
    return d.select(F.concat(F.lit("S"), ((F.col("doc_id") + F.col("line")) % 3 + 1).cast("string"), F.lit("-"), "doc_id", F.lit("-"), "line").alias("entity_id"), F.col("name").alias("business_name"), address.alias("business_address"), "country")


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = F.startswith("entity_id", F.lit("S1-"))
    return df.filter(one), df.filter(~one)


def truth(df: DataFrame) -> DataFrame:
    """(s1, t)."""
    s1, t = sides(df.withColumn("k", F.sha2(F.concat_ws("\u0001", F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit("\u0002")), F.coalesce("country", F.lit(""))), 256)))
    first = s1.groupBy("k").agg(F.min("entity_id").alias("s1"))
    return t.select("k", F.col("entity_id").alias("t")).join(first, "k").select("s1", "t")


# --- the same as DuckDB SQL --------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_map(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"


def sql_list(x: list[str]) -> str:
    return "[" + ", ".join(map(q, x)) + "]"


def _country() -> str:
    return "CASE lang " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LABELS.items()) + " ELSE lang END"


def _state() -> str:
    return "coalesce(CASE country " + " ".join(f"WHEN {q(k)} THEN ({sql_list(list(v))})[length(name) % 5 + 1]" for k, v in STATES.items()) + " ELSE '' END, '')"


RECORDS_SQL = rf"""
lines AS (SELECT doc_id, lang, generate_subscripts(p, 1) - 1 AS line, unnest(p) AS s FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
worded AS (SELECT *, list_filter(string_split_regex(s, '[ \t\r]+'), lambda x: x <> '') AS w FROM lines),
named AS (SELECT doc_id, line, array_to_string(w[1:5], ' ') AS name, array_to_string(w[6:], ' ') AS rest, {_country()} AS country FROM worded WHERE len(w) > 0),
stated AS (SELECT *, {_state()} AS state FROM named),
rec AS (SELECT 'S' || ((doc_id + line) % 3 + 1)::BIGINT || '-' || doc_id || '-' || line AS entity_id, name AS business_name,
  CASE WHEN state <> '' THEN rest || ', ' || state WHEN rest <> '' THEN rest END AS business_address, country FROM stated)"""

TRUTH_SQL = r"""
keyed0 AS (SELECT entity_id, business_name || chr(1) || coalesce(business_address, chr(2)) || chr(1) || country AS k FROM rec),
truth AS (SELECT f.s1, t.entity_id AS t FROM keyed0 t JOIN (SELECT k, min(entity_id) AS s1 FROM keyed0 WHERE starts_with(entity_id, 'S1-') GROUP BY k) f USING (k) WHERE NOT starts_with(t.entity_id, 'S1-'))"""


def sql_tokens(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda x: x <> '')"


def sql_plain(e: str) -> str:
    x = f"lower(strip_accents(replace(coalesce({e}, ''), '&', ' and ')))"
    x = rf"regexp_replace({x}, '''s\b', 's', 'g')"
    x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '([0-9])(st|nd|rd|th)( |$)', '\1\3', 'g')"
    x = rf"regexp_replace({x}, '(^| )0+([0-9])', '\1\2', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_classic(e: str) -> str:
    x = f"replace(lower(nfc_normalize(coalesce({e}, ''))), '&', ' and ')"
    x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_mapped(tokens: str, d: dict[str, str]) -> str:
    return f"list_transform({tokens}, lambda x: coalesce({sql_map(d)}[x], x))"
