"""All queries of the library by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import extract as X
from kinfold.functions import fixed
from kinfold.functions import similarity as S
from kinfold.functions import text as N
from kinfold.operators import blocking as B
from kinfold.operators import decide as D
from kinfold.operators import evaluate as E
from kinfold.operators import features as P
from kinfold.operators import models as M
from kinfold.operators import profile as A
from kinfold.operators import scoring as R
from kinfold.operators import tokens as T
from kinfold.operators import validate as V
from kinfold.plans import linkage as L
from kinfold.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401  the driver's entry reads them here
from kinfold.plans.registry import chained as _with
from kinfold.plans.views import RECORDS_SQL, TRUTH_SQL, q, records, sides, sql_classic, sql_list, sql_map, sql_mapped, sql_plain, sql_tokens, truth
from kinfold.sources import records as SRC
from kinfold.sources import sinks as K
from kinfold.sources.shared import fresh_folder, kept_alone, kept_table

#: Blocking as the queries run it, with the library's own caps.
SPEC = B.Blocking()
CONFLICT = B.Blocking(channels=SPEC.channels, conflict_penalty=0.6, both_bonus=0.0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- normalisation and extraction, over whole texts ----------------------------------------------


@query("er_norm_classic", f"""
WITH c AS (SELECT doc_id, {sql_classic("text")} AS clean FROM documents),
n AS (SELECT *, {sql_tokens("clean")} AS toks, list_filter({sql_tokens("clean")}, lambda x: NOT list_contains({sql_list(fixed.LEGAL_SUFFIXES)}, x)) AS kept FROM c)
SELECT doc_id, clean, CASE WHEN len(kept) = 0 THEN clean ELSE array_to_string(kept, ' ') END AS norm_name, array_to_string({sql_mapped("toks", fixed.CLASSIC_ADDRESS)}, ' ') AS norm_addr,
  array_to_string(list_sort(list_distinct(toks)), ' ') AS sorted_tokens, array_to_string(list_transform(toks, lambda x: x[1]), '') AS acronym FROM n
""")
def er_norm_classic(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", N.classic_clean(F.col("text")).alias("clean"))
    c = F.col("clean")
    return d.select("doc_id", "clean", N.classic_name(c).alias("norm_name"), N.classic_address(c).alias("norm_addr"), N.sorted_tokens(c).alias("sorted_tokens"), N.acronym(N.tokens(c)).alias("acronym"))


@query("er_norm_plain", f"""
WITH c AS (SELECT doc_id, {sql_plain("text")} AS clean FROM documents), t AS (SELECT *, {sql_tokens("clean")} AS toks FROM c)
SELECT doc_id, clean, len(toks)::INT AS n_tokens, len(list_distinct(list_transform(range(1, greatest(length(clean) - 3, 0) + 1), lambda i: substring(clean, i, 4))))::INT AS n_grams,
  array_to_string(CASE WHEN len(toks) < 2 THEN [] ELSE list_transform(range(1, len(toks)), lambda i: toks[i] || '_' || toks[i + 1]) END, ' ') AS bigrams FROM t
""")
def er_norm_plain(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", N.plain_clean(F.col("text")).alias("clean")).withColumn("toks", N.tokens(F.col("clean")))
    return d.select("doc_id", "clean", F.size("toks").alias("n_tokens"), F.size(N.grams(F.col("clean"))).alias("n_grams"), F.array_join(N.bigrams(F.col("toks")), " ").alias("bigrams"))


_STATE_NAMES = sorted((fixed.US_STATES | {}).items(), key=lambda x: -len(x[0]))


@query("er_norm_address")
def er_norm_address(spark, sf_dir):
    """``plain_address``, in rows only: DuckDB's expressions have no look-around."""
    return documents(spark, sf_dir).select("doc_id", N.plain_address(F.concat(F.col("text"), F.lit(", West Virginia, new york"))).alias("clean"))


_POSTAL = r"""CASE WHEN contains(c, 'US') OR contains(c, 'UNITED STATES') THEN nullif(regexp_extract(a, '\b([0-9]{5})(-[0-9]{4})?\b', 1), '')
 WHEN contains(c, 'IN') OR contains(c, 'INDIA') THEN nullif(regexp_extract(a, '\b([0-9]{6})\b', 1), '')
 WHEN contains(c, 'FR') OR contains(c, 'FRANCE') THEN nullif(regexp_extract(a, '\b([0-9]{5})\b', 1), '')
 ELSE coalesce(nullif(regexp_extract(a, '\b([0-9]{6})\b', 1), ''), nullif(regexp_extract(a, '\b([0-9]{5})(-[0-9]{4})?\b', 1), '')) END"""


@query("er_extract", rf"""
WITH d AS (SELECT doc_id, text AS a, upper(trim(coalesce(lang, ''))) AS c, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, {_POSTAL} AS postal, coalesce(nullif(regexp_extract(t, '\b([0-9]{{6}})\b', 1), ''), nullif(regexp_extract(t, '\b([0-9]{{5}})(-[0-9]{{4}})?\b', 1), '')) AS any_postal FROM d),
s AS (SELECT *, regexp_replace(CASE WHEN any_postal IS NULL THEN a ELSE replace(a, any_postal, ' ') END, '\b[0-9]{{5,6}}\b', ' ', 'g') AS masked,
  length(t) AS n, length(regexp_replace(t, '[^\x00-\x7f]', '', 'g')) AS n_ascii, length(regexp_replace(t, '[^{fixed.INDIC_CLASSIC}]', '', 'g')) AS n_indic, length(regexp_replace(t, '[^{fixed.LATIN_EXTENDED}]', '', 'g')) AS n_latin FROM p)
SELECT doc_id, postal, lower(nullif(regexp_extract(masked, '\b([0-9]+[a-zA-Z]?)\b', 1), '')) AS street_number,
  regexp_replace(nullif(regexp_extract(t, '([0-9]+)', 1), ''), '^0+([0-9])', '\1') AS first_number,
  array_to_string(list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\1')), ',') AS digit_runs,
  CASE WHEN n = 0 THEN 1.0 ELSE n_ascii / n END::DOUBLE AS ascii_share, CASE WHEN n = 0 THEN 0.0 ELSE n_latin / n END::DOUBLE AS latin_share,
  CASE WHEN n > 0 AND n_indic / n > 0.3 THEN 'indic' WHEN n > 0 AND n_latin / n > 0.05 THEN 'latin_accented' ELSE 'ascii' END AS script,
  (a IS NULL OR length(a) < 3) AS missing, regexp_matches(t, '(?i)\.com|www\.|^#|^@') AS domain FROM s
""")
def er_extract(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", X.postal_code(t, F.col("lang")).alias("postal"), X.street_number(t).alias("street_number"), X.first_number(t).alias("first_number"), F.array_join(X.digit_runs(t), ",").alias("digit_runs"),
        X.script_share(t, "ascii").alias("ascii_share"), X.script_share(t, "latin_ext").alias("latin_share"), X.script_type(t).alias("script"), X.address_missing(t).alias("missing"), X.looks_like_domain(t).alias("domain"),
    )


#: Forms of companies for French names, dotted and not, and near misses.
FRENCH_TAILS = ("", " SARL", " S.A.R.L", " S. A. R. L", " sas", " S.A.S.U", " SASU", " S.A", " sa", " e.u.r.l", " SCI", " E.I", " snc", " sarla", " S A S")
_FRENCH_TAILS_SQL = f"({sql_list(list(FRENCH_TAILS))})[length(business_name) % {len(FRENCH_TAILS)} + 1]"


@query("er_country_codes", f"""
WITH n AS (SELECT n_nationkey, n_name, upper(trim(n_name)) AS u FROM nation)
SELECT n_nationkey, coalesce({sql_map(fixed.COUNTRIES)}[u], u) AS code, coalesce({sql_map(fixed.CACHE_COUNTRIES)}[u], u) AS cache_code FROM n
""")
def er_country_codes(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select("n_nationkey", N.country_code(F.col("n_name")).alias("code"), N.country_code(F.col("n_name"), fixed.CACHE_COUNTRIES).alias("cache_code"))


_FORM = lambda f: rf"regexp_matches(plain, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({fixed.FRENCH_FORMS[f][0]})($|[^\p{{L}}\p{{M}}\p{{N}}_])')"
_FRENCH = {"llc": _FORM("sarl"), "corp": _FORM("sasu"), "inc": f"{_FORM('sas')} AND NOT {_FORM('sasu')}", "ltd": f"{_FORM('sa')} AND NOT {_FORM('sas')} AND NOT {_FORM('sasu')} AND NOT {_FORM('sarl')}", "pc": _FORM("eurl"), "llp": _FORM("sci"), "co": _FORM("ei"), "pub": _FORM("snc")}
_LEGAL = ", ".join(f"CASE WHEN country = 'France' THEN {_FRENCH.get(k, 'false')} ELSE list_has_any(toks, {sql_list(w)}) END AS lg_{k}" for k, w in fixed.LEGAL_CATEGORIES.items())


@query("er_legal_flags", f"""
WITH {RECORDS_SQL}, forms AS (SELECT entity_id, business_name || CASE WHEN country = 'France' THEN {_FRENCH_TAILS_SQL} ELSE '' END AS business_name, country FROM rec),
t AS (SELECT entity_id, country, {sql_tokens(sql_plain("business_name"))} AS toks, lower(strip_accents(business_name)) AS plain FROM forms)
SELECT entity_id, {_LEGAL} FROM t
""")
def er_legal_flags(spark, sf_dir):
    """The flags of every record; French names get a form by their length, since the tables have none."""
    tail = F.get(F.array(*[F.lit(x) for x in FRENCH_TAILS]), F.length("business_name") % len(FRENCH_TAILS))
    d = records(spark, sf_dir).withColumn("business_name", F.when(F.col("country") == "France", F.concat("business_name", tail)).otherwise(F.col("business_name"))).withColumn("toks", N.tokens(N.plain_clean(F.col("business_name"))))
    return d.select("entity_id", *[c.alias(k) for k, c in X.legal_flags(F.col("business_name"), F.col("toks"), F.col("country")).items()])


# --- records ---------------------------------------------------------------------------------------


@query("er_records", f"WITH {RECORDS_SQL} SELECT * FROM rec")
def er_records(spark, sf_dir):
    return records(spark, sf_dir)


@query("er_record_cache", f"""
WITH {RECORDS_SQL},
c0 AS (SELECT entity_id, coalesce(business_name, '') AS raw_name, coalesce(business_address, '') AS raw_addr, coalesce({sql_map(fixed.CACHE_COUNTRIES)}[upper(trim(country))], upper(trim(country))) AS country FROM rec),
c1 AS (SELECT *, {sql_tokens(sql_classic("raw_name"))} AS nt, {sql_classic("raw_name")} AS nc, {sql_tokens(sql_classic("raw_addr"))} AS at0 FROM c0),
c2 AS (SELECT *, list_filter(nt, lambda x: NOT list_contains({sql_list(fixed.LEGAL_SUFFIXES)}, x)) AS kept, {sql_mapped("at0", fixed.CLASSIC_ADDRESS)} AS atk FROM c1),
c3 AS (SELECT *, CASE WHEN len(kept) = 0 THEN nc ELSE array_to_string(kept, ' ') END AS norm_name, array_to_string(atk, ' ') AS norm_addr FROM c2),
c4 AS (SELECT *, {sql_tokens("norm_name")} AS nnt FROM c3)
SELECT entity_id, country, norm_name, norm_addr, array_to_string(list_sort(list_distinct(nnt)), ' ') AS sort_name, array_to_string(list_sort(list_distinct({sql_tokens("norm_addr")})), ' ') AS sort_addr,
  len(nnt)::INT AS name_len, len({sql_tokens("norm_addr")})::INT AS addr_len, coalesce(nnt[1], '') AS first_tok, array_to_string(list_transform(nnt, lambda x: x[1]), '') AS acronym FROM c4
""")
def er_record_cache(spark, sf_dir):
    return T.record_cache(records(spark, sf_dir)).select("entity_id", "country", "norm_name", "norm_addr", "sort_name", "sort_addr", "name_len", "addr_len", "first_tok", "acronym")


def _component(x: str) -> str:
    whole = "CASE country " + " ".join(f"WHEN {q(c)} THEN {sql_map(fixed.state_codes(c))}[array_to_string({x}, ' ')]" for c in ("US", "India", "France")) + " ELSE NULL END"
    return f"CASE WHEN ({whole}) IS NOT NULL THEN [{whole}] ELSE {x} END"


TOKENS_SQL = f"""
tk0 AS (SELECT entity_id, country, business_name, business_address, {sql_tokens(sql_plain("business_name"))} AS nt, list_transform(string_split(coalesce(business_address, ''), ','), lambda c: {sql_tokens(sql_plain("c"))}) AS comps FROM rec),
tk1 AS (SELECT * EXCLUDE (comps, nt), CASE WHEN country = 'France' THEN {sql_mapped("nt", fixed.FRENCH_NAMES)} ELSE nt END AS ntok_all, flatten(list_transform(comps, lambda x: {_component("x")})) AS a0 FROM tk0),
tk2 AS (SELECT * EXCLUDE (a0), list_filter(ntok_all, lambda x: NOT list_contains({sql_list(fixed.LEGAL_WORDS)}, x)) AS ntok, CASE WHEN country = 'France' THEN {sql_mapped("a0", fixed.FRENCH_ADDRESS)} ELSE {sql_mapped("a0", fixed.ADDRESS)} END AS atok FROM tk1),
tk AS (SELECT *, CASE WHEN len(atok) < 2 THEN [] ELSE list_transform(range(1, len(atok)), lambda i: atok[i] || '_' || atok[i + 1]) END AS abig,
  list_sort(list_distinct(list_filter(atok, lambda x: starts_with(x, '_st_')))) AS states, array_to_string(ntok, '') AS ng, array_to_string(ntok, ' ') AS nk,
  regexp_replace(nullif(regexp_extract(coalesce(business_address, ''), '([0-9]+)', 1), ''), '^0+([0-9])', '\\1') AS num FROM tk2)"""

_J = lambda c: f"array_to_string({c}, ' ') AS {c}"


@query("er_record_tokens", f"WITH {RECORDS_SQL}, {TOKENS_SQL} SELECT entity_id, {_J('ntok_all')}, {_J('ntok')}, {_J('atok')}, {_J('abig')}, {_J('states')}, num FROM tk")
def er_record_tokens(spark, sf_dir):
    d = T.record_tokens(records(spark, sf_dir))
    return d.select("entity_id", *[F.array_join(c, " ").alias(c) for c in ("ntok_all", "ntok", "atok", "abig", "states")], "num")


BAGS_SQL = """
bag AS (SELECT entity_id, country, states, 'name' AS channel, unnest(list_filter(list_distinct(list_concat(list_transform(ntok, lambda x: 'n:' || x), ['n:' || ng], list_transform(range(1, greatest(length(ng) - 3, 0) + 1), lambda i: 'c:' || substring(ng, i, 4)))), lambda x: length(x) > 2)) AS token FROM tk
  UNION ALL SELECT entity_id, country, states, 'addr', unnest(list_filter(list_distinct(list_concat(list_transform(atok, lambda x: 'a:' || x), list_transform(abig, lambda x: 'b:' || x))), lambda x: length(x) > 2)) FROM tk)"""


@query("er_token_bags", f"WITH {RECORDS_SQL}, {TOKENS_SQL}, {BAGS_SQL} SELECT channel, token, count(*)::BIGINT AS df FROM bag GROUP BY ALL")
def er_token_bags(spark, sf_dir):
    return T.channel_tokens(T.record_tokens(records(spark, sf_dir)), SPEC.channels).groupBy("channel", "token").agg(F.count("*").alias("df"))


def _block_sql(spec: B.Blocking, by_state: bool) -> str:
    if by_state:
        parts = """
qp AS (SELECT entity_id, coalesce(country, '') AS c, unnest(CASE WHEN len(states) > 0 THEN list_transform(states, lambda x: coalesce(country, '') || '|' || x) ELSE [coalesce(country, '') || '|*'] END) AS part FROM tk WHERE starts_with(entity_id, 'S1-')),
tp AS (SELECT entity_id, unnest(list_concat(list_transform(states, lambda x: coalesce(country, '') || '|' || x), [coalesce(country, '') || '|*'])) AS part FROM tk WHERE NOT starts_with(entity_id, 'S1-')
  UNION ALL SELECT entity_id, part FROM tk JOIN (SELECT DISTINCT c, part FROM qp WHERE NOT ends_with(part, '|*')) p ON coalesce(tk.country, '') = p.c WHERE NOT starts_with(entity_id, 'S1-') AND len(states) = 0)"""
    else:
        parts = "qp AS (SELECT entity_id, country AS part FROM tk WHERE starts_with(entity_id, 'S1-')), tp AS (SELECT entity_id, country AS part FROM tk WHERE NOT starts_with(entity_id, 'S1-'))"
    cap = " ".join(f"WHEN {q(c.name)} THEN {c.cap}" for c in spec.channels)
    penalty = f"- CASE WHEN len(sq.states) > 0 AND len(st.states) > 0 AND NOT list_has_any(sq.states, st.states) THEN {spec.conflict_penalty} ELSE 0.0 END" if spec.conflict_penalty else ""
    return f"""
{parts},
sizes AS (SELECT part, count(*) AS n FROM tp WHERE part IN (SELECT part FROM qp) GROUP BY part),
vocab AS (SELECT part, channel, token, count(*) AS df, any_value(n) AS n FROM bag JOIN tp USING (entity_id) JOIN sizes USING (part) GROUP BY part, channel, token HAVING count(*) <= CASE channel {cap} END),
idf AS (SELECT part, channel, token, df, ln(n) - ln(df) AS idf FROM vocab),
known AS (SELECT part, entity_id, channel, token, idf, sqrt(sum(idf * idf) OVER (PARTITION BY part, entity_id, channel)) AS norm FROM bag JOIN (SELECT * FROM qp_all UNION ALL SELECT * FROM tp) p USING (entity_id) JOIN idf USING (part, channel, token)),
w AS (SELECT part, entity_id, channel, token, idf / norm AS w FROM known WHERE norm > 0),
raw AS (SELECT a.part, a.entity_id AS s1, b.entity_id AS t, round(sum(CASE WHEN a.channel = 'name' THEN a.w * b.w ELSE 0.0 END), 6) AS cn, round(sum(CASE WHEN a.channel = 'addr' THEN a.w * b.w ELSE 0.0 END), 6) AS ca
  FROM w a JOIN w b USING (part, channel, token) WHERE starts_with(a.entity_id, 'S1-') AND NOT starts_with(b.entity_id, 'S1-') GROUP BY 1, 2, 3),
scored0 AS (SELECT part, s1, t, cn, ca, cn + ca {penalty} AS base FROM raw JOIN tk sq ON sq.entity_id = s1 JOIN tk st ON st.entity_id = t WHERE round(cn + ca, 8) >= {spec.floor}),
scored AS (SELECT part, s1, t, cn, ca, round(base + {spec.both_bonus} * least(cn, ca), 8) AS sc FROM scored0 WHERE round(base, 8) >= {spec.floor}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part, s1 ORDER BY sc DESC, t) - 1 AS f, row_number() OVER (PARTITION BY part, t ORDER BY sc DESC, s1) - 1 AS r FROM scored),
best AS (SELECT s1, t, max({{'sc': sc, 'cn': cn, 'ca': ca}}) AS b, min(f) < {spec.forward} AS in_f, min(r) < {spec.reverse} AS in_r FROM ranked WHERE f < {spec.forward} OR r < {spec.reverse} GROUP BY s1, t),
cand AS (SELECT s1, t, b.sc AS sc, b.cn AS cn, b.ca AS ca, CASE WHEN in_f THEN least(row_number() OVER (PARTITION BY s1, in_f ORDER BY b.sc DESC, t) - 1, 99) ELSE 99 END::INT AS fwd_rank,
  CASE WHEN in_r THEN least(row_number() OVER (PARTITION BY t, in_r ORDER BY b.sc DESC, s1) - 1, 99) ELSE 99 END::INT AS rev_rank FROM best)""".replace("SELECT * FROM qp_all", "SELECT entity_id, part FROM qp")


BASE = (RECORDS_SQL, TOKENS_SQL, BAGS_SQL)
CAND = (*BASE, _block_sql(SPEC, True))
KEPT = (*CAND, f"kept AS (SELECT * FROM cand WHERE fwd_rank < {SPEC.forward} OR rev_rank < {SPEC.reverse})")


#: What blocking reads of a record's tokens.
BLOCKED = ("entity_id", "country", "ntok", "atok", "states")


def tokened(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tokens of both sides, normalised once and stored, since every step reads them."""
    return sides(T.unpacked(kept_table(T.packed(T.record_tokens(records(spark, sf_dir))))))


def blocked_tokens(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Likewise, where blocking alone reads them."""
    return sides(kept_table(T.record_tokens(records(spark, sf_dir)).select(*BLOCKED)))


def candidates(spark, sf_dir) -> DataFrame:
    return kept_alone(spark, lambda: B.kept(B.block(*blocked_tokens(spark, sf_dir), SPEC), SPEC))


@query("er_vocabulary", _with(*CAND) + " SELECT part, channel, token, df::BIGINT AS df, round(idf, 9) AS idf FROM idf")
def er_vocabulary(spark, sf_dir):
    s1, t = tokened(spark, sf_dir)
    a, b = B.in_parts(s1, t)
    b = b.join(a.select("part").distinct(), "part", "left_semi")
    return B.vocabulary(T.channel_tokens(b, SPEC.channels, ("part",)), b.groupBy("part").agg(F.count("*").alias("n")), SPEC.channels).select("part", "channel", "token", "df", F.round("idf", 9).alias("idf"))


@query("er_block", _with(*CAND) + " SELECT * FROM cand")
def er_block(spark, sf_dir):
    return B.block(*blocked_tokens(spark, sf_dir), SPEC)


@query("er_block_country", _with(*BASE, _block_sql(SPEC, False)) + " SELECT * FROM cand")
def er_block_country(spark, sf_dir):
    return B.block(*blocked_tokens(spark, sf_dir), SPEC, by_state=False)


@query("er_block_conflict", _with(*BASE, _block_sql(CONFLICT, False)) + " SELECT * FROM cand")
def er_block_conflict(spark, sf_dir):
    return B.block(*blocked_tokens(spark, sf_dir), CONFLICT, by_state=False)


@query("er_top_names", _with(*BASE, _block_sql(SPEC, False)) + " SELECT * FROM (SELECT s1, t, cn AS sc, (row_number() OVER (PARTITION BY part, s1 ORDER BY cn DESC, t) - 1)::INT AS rank FROM raw WHERE cn > 0 AND cn >= 0.5) WHERE rank < 3")
def er_top_names(spark, sf_dir):
    s1, t = tokened(spark, sf_dir)
    return B.top_in_channel(*B.in_parts(s1, t, False), SPEC.channels[0], 3, 0.5)


@query("er_candidates", _with(*KEPT) + " SELECT * FROM kept")
def er_candidates(spark, sf_dir):
    return candidates(spark, sf_dir)


@query("er_recall", _with(*KEPT, TRUTH_SQL) + " SELECT count(*) FILTER (k.s1 IS NOT NULL)::BIGINT AS hits, count(*)::BIGINT AS total, CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (k.s1 IS NOT NULL) / count(*) END::DOUBLE AS recall FROM truth g LEFT JOIN kept k ON k.s1 = g.s1 AND k.t = g.t")
def er_recall(spark, sf_dir):
    return B.recall(candidates(spark, sf_dir), truth(records(spark, sf_dir)))


@query("er_candidates_per_query", _with(*KEPT) + " SELECT queries, pairs, CASE WHEN queries = 0 THEN 0.0 ELSE pairs / queries END::DOUBLE AS per_query FROM (SELECT count(DISTINCT entity_id) AS queries FROM rec WHERE starts_with(entity_id, 'S1-')), (SELECT count(*) AS pairs FROM kept)")
def er_candidates_per_query(spark, sf_dir):
    return B.candidates_per_query(candidates(spark, sf_dir), sides(records(spark, sf_dir))[0])


# --- classic blocking --------------------------------------------------------------------------------

_GOOD = f"NOT list_contains({sql_list(fixed.GENERIC)}, first_tok) AND first_tok <> ''"
CLASSIC_SQL = f"""
k0 AS (SELECT entity_id, coalesce({sql_map(fixed.COUNTRIES)}[upper(trim(country))], upper(trim(country))) AS country, {sql_classic("business_name")} AS nc, {sql_tokens(sql_classic("business_name"))} AS nt, {sql_tokens(sql_classic("business_address"))} AS at0, business_address AS a, upper(trim(coalesce(country, ''))) AS c FROM rec),
k1 AS (SELECT *, list_filter(nt, lambda x: NOT list_contains({sql_list(fixed.LEGAL_SUFFIXES)}, x)) AS kp, {_POSTAL} AS postal,
  coalesce(nullif(regexp_extract(a, '\\b([0-9]{{6}})\\b', 1), ''), nullif(regexp_extract(a, '\\b([0-9]{{5}})(-[0-9]{{4}})?\\b', 1), '')) AS any_postal FROM k0),
k2 AS (SELECT *, CASE WHEN len(kp) = 0 THEN nc ELSE array_to_string(kp, ' ') END AS norm_name, array_to_string({sql_mapped("at0", fixed.CLASSIC_ADDRESS)}, ' ') AS norm_addr,
  lower(nullif(regexp_extract(regexp_replace(CASE WHEN any_postal IS NULL THEN a ELSE replace(a, any_postal, ' ') END, '\\b[0-9]{{5,6}}\\b', ' ', 'g'), '\\b([0-9]+[a-zA-Z]?)\\b', 1), '')) AS st_num FROM k1),
k3 AS (SELECT *, {sql_tokens("norm_name")} AS tn, {sql_tokens("norm_addr")} AS ta FROM k2),
keyed AS (SELECT *, array_to_string(list_sort(list_distinct(tn)), ' ') AS sort_name, array_to_string(list_sort(list_distinct(ta)), ' ') AS sort_addr, coalesce(tn[1], '') AS first_tok FROM k3),
keys AS (SELECT entity_id, country, 'exact_name' AS strategy, nullif(norm_name, '') AS key FROM keyed UNION ALL SELECT entity_id, country, 'sorted_name', nullif(sort_name, '') FROM keyed UNION ALL SELECT entity_id, country, 'sorted_addr', nullif(sort_addr, '') FROM keyed
  UNION ALL SELECT entity_id, country, 'postal_token', CASE WHEN {_GOOD} THEN postal || '|' || first_tok END FROM keyed UNION ALL SELECT entity_id, country, 'postal_street', postal || '|' || st_num FROM keyed
  UNION ALL SELECT entity_id, country, 'first_token', CASE WHEN {_GOOD} AND length(first_tok) >= 4 THEN first_tok END FROM keyed),
kpairs AS (SELECT DISTINCT a.entity_id AS s1, b.entity_id AS t, strategy FROM keys a JOIN keys b USING (country, strategy, key) WHERE a.key IS NOT NULL AND starts_with(a.entity_id, 'S1-') AND NOT starts_with(b.entity_id, 'S1-'))"""


def keyed_sides(spark, sf_dir):
    return sides(kept_table(B.keyed(records(spark, sf_dir))))


@query("er_key_pairs", _with(RECORDS_SQL, CLASSIC_SQL) + " SELECT * FROM kpairs")
def er_key_pairs(spark, sf_dir):
    return B.key_pairs(*keyed_sides(spark, sf_dir))


def _grams_sql(index: B.GramIndex) -> str:
    own = f"lower({index.column})"
    grams = "flatten(list_transform(ws, lambda w: list_concat(list_transform(range(1, length(w)), lambda i: substring(w, i, 2)), CASE WHEN length(w) >= 3 THEN list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)) ELSE [] END, CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 2), lambda i: substring(w, i, 4)) ELSE [] END)))"
    x = index.column
    return f"""
{x}_w AS (SELECT entity_id, country, list_transform({sql_tokens(own)}, lambda x: ' ' || x || ' ') AS ws FROM keyed),
{x}_g AS (SELECT entity_id, country, unnest({grams}) AS g FROM {x}_w),
{x}_tf AS (SELECT entity_id, country, g, count(*) AS tf FROM {x}_g GROUP BY ALL),
{x}_n AS (SELECT country, count(*) AS n FROM keyed WHERE NOT starts_with(entity_id, 'S1-') GROUP BY country),
{x}_idf AS (SELECT country, g, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM {x}_tf JOIN {x}_n USING (country) WHERE NOT starts_with(entity_id, 'S1-') GROUP BY country, g),
{x}_v AS (SELECT entity_id, country, g, tf * idf AS v FROM {x}_tf JOIN {x}_idf USING (country, g)),
{x}_u AS (SELECT entity_id, country, g, v / sqrt(sum(v * v) OVER (PARTITION BY country, entity_id)) AS v FROM {x}_v),
{x}_s AS (SELECT a.entity_id AS s1, b.entity_id AS t, round(sum(a.v * b.v), 6) AS sc FROM {x}_u a JOIN {x}_u b USING (country, g) WHERE starts_with(a.entity_id, 'S1-') AND NOT starts_with(b.entity_id, 'S1-') GROUP BY 1, 2),
{x}_p AS (SELECT s1, t, sc FROM {x}_s WHERE sc > {index.floor} QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY sc DESC, t) <= {index.top})"""


NAME_INDEX = B.GRAM_INDEXES[0]


@query("er_gram_pairs", _with(RECORDS_SQL, CLASSIC_SQL, _grams_sql(NAME_INDEX)) + " SELECT * FROM norm_name_p")
def er_gram_pairs(spark, sf_dir):
    return B.gram_pairs(*keyed_sides(spark, sf_dir), NAME_INDEX)


def _classic_sql(*indexes: B.GramIndex) -> str:
    every = " UNION ".join(["SELECT s1, t FROM kpairs", *(f"SELECT s1, t FROM {i.column}_p" for i in indexes)])
    return _with(RECORDS_SQL, CLASSIC_SQL, *map(_grams_sql, indexes)) + f""", every AS ({every}),
sims AS (SELECT s1, t, round(0.6 * (len(list_intersect(list_distinct(a.tn), list_distinct(b.tn))) / greatest(1, len(list_distinct(list_concat(a.tn, b.tn))))) + 0.4 * (len(list_intersect(list_distinct(a.ta), list_distinct(b.ta))) / greatest(1, len(list_distinct(list_concat(a.ta, b.ta))))), 8) AS sim FROM every JOIN keyed a ON a.entity_id = s1 JOIN keyed b ON b.entity_id = t)
SELECT * FROM (SELECT s1, t, sim, row_number() OVER (PARTITION BY s1 ORDER BY sim DESC, t)::INT AS rank FROM sims) WHERE rank <= 30"""


@query("er_classic_candidates", _classic_sql(*B.GRAM_INDEXES))
def er_classic_candidates(spark, sf_dir):
    """By keys, names and addresses."""
    return B.classic_candidates(*keyed_sides(spark, sf_dir), 30)


@query("er_classic_by_name", _classic_sql(NAME_INDEX))
def er_classic_by_name(spark, sf_dir):
    """A variant of ``er_classic_candidates``: by keys and names alone."""
    return B.classic_candidates(*keyed_sides(spark, sf_dir), 30, (NAME_INDEX,))


# --- features ------------------------------------------------------------------------------------------


@query("er_name_counts", _with(*BASE) + " SELECT country, nk, count(*) FILTER (starts_with(entity_id, 'S1-'))::BIGINT AS nk_cnt_s1, count(*) FILTER (NOT starts_with(entity_id, 'S1-'))::BIGINT AS nk_cnt_t FROM tk GROUP BY country, nk")
def er_name_counts(spark, sf_dir):
    return T.name_counts(*tokened(spark, sf_dir))


@query("er_pair_context", _with(*KEPT) + " SELECT s1, t, count(*) OVER (PARTITION BY s1)::INT AS n_cand, round(max(sc) OVER (PARTITION BY s1) - sc, 8) AS sc_gap_s1, count(*) OVER (PARTITION BY t)::INT AS n_s1_for_t, round(max(sc) OVER (PARTITION BY t) - sc, 8) AS sc_gap_t FROM kept")
def er_pair_context(spark, sf_dir):
    return P.with_context(candidates(spark, sf_dir)).select("s1", "t", "n_cand", "sc_gap_s1", "n_s1_for_t", "sc_gap_t")


_VIEW_SQL = r"""
view0 AS (SELECT *, ntok_all AS toks, lower(strip_accents(business_name)) AS plain FROM tk),
view AS (SELECT *, """ + _LEGAL + r""", list_filter(atok, lambda x: regexp_matches(x, '^[0-9]+$')) AS nums, list_filter(atok, lambda x: starts_with(x, '_st_'))[1] AS st,
  list_transform(regexp_extract_all(coalesce(business_address, ''), '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\1')) AS dig FROM view0)"""
_JACC = lambda a, b: f"len(list_intersect(list_distinct({a}), list_distinct({b}))) / greatest(1, len(list_distinct(list_concat({a}, {b}))))"
_LESS = lambda a, b: f"len(list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x)))::INT"
_NATIVE = ["num1_eq", "nums_jacc", "nums_in", "st_eq", "a_null_2", "n_domain_2", "is_s3", "dig_jacc", "dig_t_extra", "dig_s_extra", "dig_n2", "n_len_1", "n_len_2", "a_len_1", "a_len_2", "n_nonlatin_2", *[f"lg_{k}" for k in P.CATEGORIES], "lg_conflict"]
_LEGAL_PAIR = ", ".join(f"(a.lg_{k}::INT * 2 + b.lg_{k}::INT)::INT AS lg_{k}" for k in P.CATEGORIES) + ", (" + " + ".join(f"(a.lg_{k} <> b.lg_{k})::INT" for k in P.CATEGORIES) + ")::INT AS lg_conflict"


@query("er_features_native", _with(*KEPT, _VIEW_SQL) + rf""" SELECT s1, t, coalesce((a.num = b.num)::INT, -1) AS num1_eq, ({_JACC("a.nums", "b.nums")})::DOUBLE AS nums_jacc, ({_LESS("b.nums", "a.nums")} = 0)::INT AS nums_in, coalesce((a.st = b.st)::INT, -1) AS st_eq,
  (b.business_address IS NULL OR length(b.business_address) < 3)::INT AS a_null_2, regexp_matches(b.business_name, '(?i)\.com|www\.|^#|^@')::INT AS n_domain_2, starts_with(t, 'S3')::INT AS is_s3, ({_JACC("a.dig", "b.dig")})::DOUBLE AS dig_jacc,
  {_LESS("b.dig", "a.dig")} AS dig_t_extra, {_LESS("a.dig", "b.dig")} AS dig_s_extra, len(b.dig)::INT AS dig_n2, len(a.ntok)::INT AS n_len_1, len(b.ntok)::INT AS n_len_2, len(a.atok)::INT AS a_len_1, len(b.atok)::INT AS a_len_2, regexp_matches(b.business_name, '[{fixed.INDIC}]')::INT AS n_nonlatin_2, {_LEGAL_PAIR}
  FROM kept JOIN view a ON a.entity_id = s1 JOIN view b ON b.entity_id = t""")
def er_features_native(spark, sf_dir):
    s1, t = tokened(spark, sf_dir)
    c = kept_table(B.kept(B.block(s1, t, SPEC), SPEC))
    return P.native_features(P.paired(c, T.record_view(s1), T.record_view(t))).select("s1", "t", *_NATIVE)


@query("er_features_learned")
def er_features_learned(spark, sf_dir):
    """All 56 features; the kernels' values are tested by hand."""
    s1, t = tokened(spark, sf_dir)
    return L.featured(s1, t, kept_table(B.kept(B.block(s1, t, SPEC), SPEC)))


@query("er_jaro_winkler", _with(*KEPT) + " SELECT s1, t, round(jaro_winkler_similarity(regexp_replace(a.nk, '[^\x00-\x7f]', '?', 'g'), regexp_replace(b.nk, '[^\x00-\x7f]', '?', 'g')), 6) AS jw FROM kept JOIN tk a ON a.entity_id = s1 JOIN tk b ON b.entity_id = t WHERE a.nk <> '' AND b.nk <> ''")
def er_jaro_winkler(spark, sf_dir):
    s1, t = tokened(spark, sf_dir)
    c = B.kept(B.block(s1, t, SPEC), SPEC).select("s1", "t")
    # DuckDB compares bytes, so letters beyond ASCII are one mark on both sides
    key = lambda d, i, x: d.select(F.col("entity_id").alias(i), F.regexp_replace(F.array_join("ntok", " "), "[^\\x00-\\x7f]", "?").alias(x))
    d = c.join(key(s1, "s1", "a"), "s1").join(key(t, "t", "b"), "t").filter("a <> '' and b <> ''")
    return d.select("s1", "t", F.round(S.similarity(S.jaro_winkler, F.col("a"), F.col("b")), 6).alias("jw"))


_BG = lambda c: f"list_transform(range(1, greatest(length({c}) - 1, 0) + 1), lambda i: substring({c}, i, 2))"
_SIMPLE = lambda x: f"CASE WHEN a.{x} = b.{x} THEN 1.0 WHEN len(a.{x}_b) = 0 OR len(b.{x}_b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(list_distinct(a.{x}_b), list_distinct(b.{x}_b))) / (len(list_distinct(a.{x}_b)) + len(list_distinct(b.{x}_b))) END"
_SETJ = lambda x: f"CASE WHEN len(a.{x}) = 0 AND len(b.{x}) = 0 THEN 1.0 ELSE {_JACC('a.' + x, 'b.' + x)} END"
_CONT = lambda x: f"CASE WHEN least(len(a.{x}), len(b.{x})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(a.{x}), list_distinct(b.{x}))) / least(len(list_distinct(a.{x})), len(list_distinct(b.{x}))) END"
_HIST = lambda x: f"list_aggregate({x}_b, 'histogram') AS {x}_h"
_COS = lambda x: f"CASE WHEN len(a.{x}_b) = 0 OR len(b.{x}_b) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_intersect(map_keys(a.{x}_h), map_keys(b.{x}_h)), lambda k: least(a.{x}_h[k], b.{x}_h[k]))), 0) / (sqrt(list_sum(list_transform(map_values(a.{x}_h), lambda v: v * v))) * sqrt(list_sum(list_transform(map_values(b.{x}_h), lambda v: v * v)))) END"
_SHARE = lambda inside, empty: f"CASE WHEN length(coalesce(business_name, '')) = 0 THEN {empty} ELSE length(regexp_replace(business_name, '[^{inside}]', '', 'g')) / length(business_name) END"
RULES_SQL = (*KEPT, CLASSIC_SQL, f"""cv0 AS (SELECT *, {_BG("norm_name")} AS norm_name_b, {_BG("norm_addr")} AS norm_addr_b FROM keyed),
cv AS (SELECT cv0.*, {_HIST("norm_name")}, {_HIST("norm_addr")}, {_SHARE(fixed.INDIC_CLASSIC, "0.0")} AS dev, {_SHARE("\\x00-\\x7f", "1.0")} AS asc_share FROM cv0 JOIN (SELECT entity_id, business_name FROM rec) USING (entity_id)),
rules AS (SELECT s1, t, CASE WHEN a.norm_name = b.norm_name AND a.norm_name <> '' THEN 1.0 ELSE 0.0 END AS exact_name, {_SETJ("tn")} AS name_jaccard, {_SETJ("ta")} AS addr_jaccard, {_SIMPLE("norm_name")} AS name_ratio, {_SIMPLE("norm_addr")} AS addr_ratio,
  {_COS("norm_name")} AS name_bg_cos, {_COS("norm_addr")} AS addr_bg_cos, abs(a.dev - b.dev) AS script_dev_diff, abs(a.asc_share - b.asc_share) AS script_ascii_diff, {_CONT("tn")} AS name_containment, {_CONT("ta")} AS addr_containment, least(length(a.norm_name), length(b.norm_name)) / greatest(1, length(a.norm_name), length(b.norm_name)) AS name_len_ratio,
  CASE WHEN a.postal = b.postal THEN 1.0 ELSE 0.0 END AS postal_match, CASE WHEN a.postal[1:3] = b.postal[1:3] THEN 1.0 ELSE 0.0 END AS postal_prefix_match, CASE WHEN a.postal IS NULL OR b.postal IS NULL THEN 1.0 ELSE 0.0 END AS postal_missing,
  CASE WHEN a.st_num IS NULL OR b.st_num IS NULL THEN 0.5 WHEN a.st_num = b.st_num THEN 1.0 ELSE 0.0 END AS street_num_match, CASE WHEN a.country = '' OR b.country = '' THEN 0.5 WHEN a.country = b.country THEN 1.0 ELSE 0.0 END AS country_match,
  1.0 - levenshtein(regexp_replace(a.norm_name, '[^\\x00-\\x7f]', '?', 'g'), regexp_replace(b.norm_name, '[^\\x00-\\x7f]', '?', 'g')) / greatest(1, length(a.norm_name), length(b.norm_name)) AS lev FROM kept JOIN cv a ON a.entity_id = s1 JOIN cv b ON b.entity_id = t)""")
_RULE_COLS = ["exact_name", "name_jaccard", "addr_jaccard", "name_ratio", "addr_ratio", "name_containment", "addr_containment", "name_len_ratio", "postal_match", "postal_prefix_match", "postal_missing", "street_num_match", "country_match", "name_bg_cos", "addr_bg_cos", "script_dev_diff", "script_ascii_diff"]


def rule_features(spark, sf_dir, kernels: bool = False) -> DataFrame:
    s1, t = sides(kept_table(P.classic_packed(P.classic_view(records(spark, sf_dir)))))
    return P.features_v1(candidates(spark, sf_dir), s1, t, kernels)


@query("er_features_rules", _with(*RULES_SQL) + " SELECT s1, t, " + ", ".join(f"round({c}::DOUBLE, 9) AS {c}" for c in _RULE_COLS) + " FROM rules")
def er_features_rules(spark, sf_dir):
    return rule_features(spark, sf_dir).select("s1", "t", *[F.round(c, 9).alias(c) for c in _RULE_COLS])


@query("er_features_rules_kernels")
def er_features_rules_kernels(spark, sf_dir):
    """All 24 features with the string kernels."""
    return rule_features(spark, sf_dir, True)


@query("er_levenshtein", _with(*RULES_SQL) + " SELECT s1, t, round(lev::DOUBLE, 9) AS lev FROM rules")
def er_levenshtein(spark, sf_dir):
    s1, t = sides(kept_table(P.classic_packed(P.classic_view(records(spark, sf_dir)))))
    d = P.paired(candidates(spark, sf_dir).select("s1", "t"), s1, t)
    ascii_of = lambda c: F.regexp_replace(c, "[^\\x00-\\x7f]", "?")
    return d.select("s1", "t", F.round(P.levenshtein_similarity(ascii_of("nn_1"), ascii_of("nn_2")), 9).alias("lev"))


# --- scores and decisions --------------------------------------------------------------------------------
# The pairs' score here is their blocking score over its largest value, 2.5.

P_SQL = (*KEPT, TRUTH_SQL, "pp AS (SELECT s1, t, round(sc / 2.5, 8) AS p FROM kept)")


def probabilities(spark, sf_dir) -> DataFrame:
    return candidates(spark, sf_dir).select("s1", "t", F.round(F.col("sc") / 2.5, 8).alias("p"))


_RS = "0.28 * exact_name + 0.18 * name_ratio + 0.10 * name_ratio + 0.08 * name_ratio + 0.12 * addr_ratio + 0.08 * addr_ratio + 0.08 * postal_match + 0.04 * street_num_match + 0.04 * country_match + 0.04 * name_bg_cos + 0.04 * addr_bg_cos"


def rule_scores(spark, sf_dir, kernels: bool) -> DataFrame:
    f = rule_features(spark, sf_dir, kernels)
    return f.select("s1", "t", F.round(R.rule_score(f), 8).alias("score"))


@query("er_rule_score")
def er_rule_score(spark, sf_dir):
    """All eleven terms, with the string kernels."""
    return rule_scores(spark, sf_dir, True)


@query("er_rule_score_plain", _with(*RULES_SQL) + f" SELECT s1, t, round(({_RS})::DOUBLE, 8) AS score FROM rules")
def er_rule_score_plain(spark, sf_dir):
    """A variant: where kernels are not wanted, bigram ratios stand for them."""
    return rule_scores(spark, sf_dir, False)


_F05 = "CASE WHEN ng = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / np) * (tp / ng) / (0.25 * (tp / np) + tp / ng) END"
_PER = lambda pred: f"""s1s AS (SELECT entity_id AS s1, country FROM rec WHERE starts_with(entity_id, 'S1-')), ngs AS (SELECT s1, count(*) AS ng FROM truth GROUP BY s1), nps AS (SELECT s1, count(*) AS np, count(*) FILTER (EXISTS (SELECT 1 FROM truth g WHERE g.s1 = x.s1 AND g.t = x.t)) AS tp FROM {pred} x GROUP BY s1),
per AS (SELECT s1, country, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM s1s LEFT JOIN ngs USING (s1) LEFT JOIN nps USING (s1)), fs AS (SELECT *, {_F05} AS f05 FROM per)"""  # noqa: E731
_ASSIGNED = "assigned AS (SELECT s1, t FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) AS k FROM pp) WHERE k = 1 AND p >= 0.7)"


@query("er_over_threshold", _with(*P_SQL) + " SELECT s1, t FROM pp WHERE p >= 0.7")
def er_over_threshold(spark, sf_dir):
    return D.over_threshold(probabilities(spark, sf_dir), 0.7)


@query("er_assign", _with(*P_SQL, _ASSIGNED) + " SELECT * FROM assigned")
def er_assign(spark, sf_dir):
    return D.assign(probabilities(spark, sf_dir), 0.7)


@query("er_expected_f05", _with(*P_SQL) + """, b0 AS (SELECT s1, t, p FROM pp QUALIFY row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) = 1), b1 AS (SELECT * FROM b0 WHERE p >= 0.05),
b2 AS (SELECT *, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(p) OVER (PARTITION BY s1) AS g, product(1 - p) OVER (PARTITION BY s1) AS f0 FROM b1 WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, t)),
b3 AS (SELECT *, round(1.25 * tp / (1.25 * tp + 0.25 * (g - tp) + (k - tp)), 12) AS f FROM b2),
b4 AS (SELECT s1, CASE WHEN round(any_value(f0), 12) > max(f) THEN 0 ELSE min(k) FILTER (f = m) END AS best FROM (SELECT *, max(f) OVER (PARTITION BY s1) AS m FROM b3) GROUP BY s1)
SELECT s1, t FROM b3 JOIN b4 USING (s1) WHERE k <= best""")
def er_expected_f05(spark, sf_dir):
    return D.expected_f05(probabilities(spark, sf_dir))


@query("er_macro_f05", _with(*P_SQL, _ASSIGNED, _PER("assigned")) + " SELECT count(*)::BIGINT AS entities, round(avg(f05), 9) AS macro_f05 FROM fs")
def er_macro_f05(spark, sf_dir):
    d = records(spark, sf_dir)
    return E.macro_f05(D.assign(probabilities(spark, sf_dir), 0.7), truth(d), sides(d)[0]).select("entities", F.round("macro_f05", 9).alias("macro_f05"))


@query("er_f05_by_query", _with(*P_SQL, _ASSIGNED, _PER("assigned")) + " SELECT s1, round(f05, 9) AS f05 FROM fs")
def er_f05_by_query(spark, sf_dir):
    """F0.5 of each query, from both sides' lists."""
    d = records(spark, sf_dir)
    lists = lambda pairs, name: pairs.groupBy("s1").agg(F.collect_list("t").alias(name))
    both = sides(d)[0].select(F.col("entity_id").alias("s1")).join(lists(truth(d), "a"), "s1", "left").join(lists(D.assign(probabilities(spark, sf_dir), 0.7), "b"), "s1", "left")
    none = F.array().cast("array<string>")
    return both.select("s1", F.round(E.f05_lists(F.coalesce("a", none), F.coalesce("b", none)), 9).alias("f05"))


@query("er_report", _with(*P_SQL, _ASSIGNED, _PER("assigned")) + """, g AS (SELECT 'overall' AS kind, 'all' AS label, f05 FROM fs UNION ALL SELECT 'group', CASE WHEN ng = 0 THEN 'singleton' ELSE 'matched' END, f05 FROM fs
  UNION ALL SELECT 'bucket', CASE ng WHEN 1 THEN '1_match' WHEN 2 THEN '2_matches' ELSE '3+_matches' END, f05 FROM fs WHERE ng > 0 UNION ALL SELECT 'country', upper(country), f05 FROM fs)
SELECT kind, label, count(*)::BIGINT AS entities, round(avg(f05), 9) AS f05 FROM g GROUP BY kind, label""")
def er_report(spark, sf_dir):
    d = records(spark, sf_dir)
    return E.report(D.assign(probabilities(spark, sf_dir), 0.7), truth(d), sides(d)[0]).select("kind", "label", "entities", F.round("f05", 9).alias("f05"))


@query("er_ceiling", _with(*P_SQL, "right_ones AS (SELECT s1, t FROM pp SEMI JOIN truth USING (s1, t))", _PER("right_ones")) + " SELECT count(*)::BIGINT AS entities, round(avg(f05), 9) AS macro_f05 FROM fs")
def er_ceiling(spark, sf_dir):
    d = records(spark, sf_dir)
    return E.ceiling(candidates(spark, sf_dir), truth(d), sides(d)[0]).select("entities", F.round("macro_f05", 9).alias("macro_f05"))


def _sweep_sql(scored: str, steps: list[float]) -> str:
    """per: counts by threshold and query of the pairs in ``scored``."""
    return f"""th(threshold) AS (VALUES {", ".join(f"({v})" for v in steps)}), s1s AS (SELECT entity_id AS s1 FROM rec WHERE starts_with(entity_id, 'S1-')), ngs AS (SELECT s1, count(*) AS ng FROM truth GROUP BY s1),
hit AS (SELECT x.s1, p, g.t IS NOT NULL AS y FROM {scored} x LEFT JOIN truth g ON g.s1 = x.s1 AND g.t = x.t), nps AS (SELECT threshold, s1, count(*) AS np, count(*) FILTER (y) AS tp FROM th JOIN hit ON p >= threshold GROUP BY ALL),
per AS (SELECT threshold, s1, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM th CROSS JOIN s1s LEFT JOIN ngs USING (s1) LEFT JOIN nps USING (threshold, s1))"""


def swept(scored: DataFrame, spark, sf_dir, steps: list[float]) -> DataFrame:
    d = records(spark, sf_dir)
    return R.sweep(scored, truth(d), sides(d)[0], steps, "p").select("threshold", F.round("macro_f05", 9).alias("macro_f05"))


_BEST = "bt AS (SELECT s1, t, p FROM pp QUALIFY row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) = 1)"


@query("er_sweep", _with(*P_SQL, _sweep_sql("pp", R.RULE_GRID)) + f" SELECT threshold::DOUBLE AS threshold, round(avg({_F05}), 9) AS macro_f05 FROM per GROUP BY threshold")
def er_sweep(spark, sf_dir):
    return swept(probabilities(spark, sf_dir), spark, sf_dir, R.RULE_GRID)


@query("er_best_threshold", _with(*P_SQL, _BEST, _sweep_sql("bt", R.ASSIGNED_GRID)) + f" SELECT threshold::DOUBLE AS threshold, round(avg({_F05}), 9) AS macro_f05 FROM per GROUP BY threshold ORDER BY 2 DESC, 1 LIMIT 1")
def er_best_threshold(spark, sf_dir):
    return R.best_threshold(swept(D.best_of_target(probabilities(spark, sf_dir)), spark, sf_dir, R.ASSIGNED_GRID))


@query("er_sweep_oof", _with(*P_SQL, _sweep_sql("pp", R.OOF_GRID)) + f" SELECT threshold::DOUBLE AS threshold, round(avg({_F05}), 9) AS macro_f05 FROM per GROUP BY threshold")
def er_sweep_oof(spark, sf_dir):
    """Thresholds for out-of-fold scores, without assignment."""
    return swept(probabilities(spark, sf_dir), spark, sf_dir, R.OOF_GRID)


_BLEND = "round(0.5 * sc / 2.5 + CASE WHEN fwd_rank < 3 THEN 0.4 * cn ELSE 0 END + CASE WHEN rev_rank < 1 THEN 0.1 * ca ELSE 0 END, 8)"


@query("er_blend", _with(*KEPT) + f" SELECT s1, t, {_BLEND} AS score FROM kept")
def er_blend(spark, sf_dir):
    c = candidates(spark, sf_dir)
    parts = [c.select("s1", "t", (F.col("sc") / 2.5).alias("score")), c.filter("fwd_rank < 3").select("s1", "t", F.col("cn").alias("score")), c.filter("rev_rank < 1").select("s1", "t", F.col("ca").alias("score"))]
    return R.blend(parts).select("s1", "t", F.round("score", 8).alias("score"))


@query("er_sweep_blend", _with(*P_SQL, f"bl AS (SELECT s1, t, {_BLEND} AS p FROM kept)", _sweep_sql("bl", R.BLEND_GRID)) + f" SELECT threshold::DOUBLE AS threshold, round(avg({_F05}), 9) AS macro_f05 FROM per GROUP BY threshold")
def er_sweep_blend(spark, sf_dir):
    """Thresholds for blended scores."""
    return swept(er_blend(spark, sf_dir).withColumnRenamed("score", "p"), spark, sf_dir, R.BLEND_GRID)


@query("er_match_flagship")
def er_match_flagship(spark, sf_dir):
    """Block, compare, score by rules with all kernels, give each target to its best query, list the matches."""
    return K.id_lists(sides(records(spark, sf_dir))[0], D.assign(er_rule_score(spark, sf_dir), 0.5, "score"))


@query("er_match_plain", _with(*RULES_SQL) + f""", sc0 AS (SELECT s1, t, round(({_RS})::DOUBLE, 8) AS score FROM rules), b AS (SELECT s1, t, score FROM sc0 QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, s1) = 1)
SELECT r.entity_id AS source1_entity_id, coalesce(string_agg(b.t, ',' ORDER BY b.t), '') AS matched_entity_ids FROM rec r LEFT JOIN b ON b.s1 = r.entity_id AND b.score >= 0.5 WHERE starts_with(r.entity_id, 'S1-') GROUP BY r.entity_id""")
def er_match_plain(spark, sf_dir):
    """A variant of the flagship: bigram ratios stand for the kernels."""
    return K.id_lists(sides(records(spark, sf_dir))[0], D.assign(er_rule_score_plain(spark, sf_dir), 0.5, "score"))


# --- learning --------------------------------------------------------------------------------------------


@query("er_training_pairs")
def er_training_pairs(spark, sf_dir):
    return M.training_pairs(candidates(spark, sf_dir), truth(records(spark, sf_dir)))


@query("er_sampled_queries")
def er_sampled_queries(spark, sf_dir):
    s1 = sides(records(spark, sf_dir))[0].select(F.col("entity_id").alias("s1"), "country")
    return M.sampled_queries(candidates(spark, sf_dir), s1, 100)


@query("er_labelled_pairs", _with(*KEPT, TRUTH_SQL) + " SELECT s1, t, (EXISTS (SELECT 1 FROM truth g WHERE g.s1 = x.s1 AND g.t = x.t))::INT AS y FROM (SELECT s1, t FROM kept UNION SELECT s1, t FROM truth) x")
def er_labelled_pairs(spark, sf_dir):
    """All candidates and true pairs with their labels, none left out."""
    return M.training_pairs(candidates(spark, sf_dir), truth(records(spark, sf_dir)), None)


@query("er_learned_matches")
def er_learned_matches(spark, sf_dir):
    """Boosted trees on all 56 features with the flow's folds and trees, out of fold, each target to its best query."""
    flow = L.Flow()
    s1, t = tokened(spark, sf_dir)
    c = kept_table(B.kept(B.block(s1, t, flow.blocking), flow.blocking))
    data = kept_table(M.labelled(L.featured(s1, t, c), truth(records(spark, sf_dir))))
    scored, _ = M.out_of_fold(data, flow.folds, flow.trees)
    return D.assign(scored, flow.threshold)


_LATIN, _NAGARI = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x905 + i) for i in range(26))


@query("er_learn_dictionary", _with(RECORDS_SQL, TRUTH_SQL) + f""", p AS (SELECT {sql_tokens(sql_plain("a.business_name"))} AS x, {sql_tokens(sql_plain(f"translate(lower(b.business_name), '{_LATIN}', '{_NAGARI}')"))} AS y FROM truth JOIN rec a ON a.entity_id = s1 JOIN rec b ON b.entity_id = t),
z AS (SELECT unnest(y) AS token, unnest(x) AS latin FROM p WHERE len(x) = len(y)), al AS (SELECT * FROM z WHERE regexp_matches(token, '[{fixed.INDIC}]') AND NOT regexp_matches(latin, '[{fixed.INDIC}]')),
n AS (SELECT token, latin, count(*) AS n, sum(count(*)) OVER (PARTITION BY token) AS total FROM al GROUP BY token, latin)
SELECT token, latin FROM n WHERE n >= 3 AND n >= 0.5 * total QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, latin) = 1""")
def er_learn_dictionary(spark, sf_dir):
    """From true pairs whose targets are written in another script: the Latin letters moved to Devanagari."""
    d = records(spark, sf_dir)
    s1, t = sides(d)
    native = F.translate(F.lower("business_name"), _LATIN, _NAGARI)
    pairs = truth(d).join(s1.select(F.col("entity_id").alias("s1"), F.col("business_name").alias("n1"), F.col("business_address").alias("a1")), "s1")
    return T.learn_dictionary(pairs.join(t.select(F.col("entity_id").alias("t"), native.alias("n2"), F.col("business_address").alias("a2")), "t"))


@query("er_pair_text", _with(*KEPT) + " SELECT s1, t, a.business_name || ' | ' || coalesce(a.business_address, '') || ' | ' || a.country AS text_a, b.business_name || ' | ' || coalesce(b.business_address, '') || ' | ' || b.country AS text_b FROM kept JOIN rec a ON a.entity_id = s1 JOIN rec b ON b.entity_id = t")
def er_pair_text(spark, sf_dir):
    s1, t = sides(records(spark, sf_dir))
    own = lambda d, i, x: d.select(F.col("entity_id").alias(i), R.pair_text(F.col("business_name"), F.col("business_address"), F.col("country")).alias(x))
    return candidates(spark, sf_dir).select("s1", "t").join(own(s1, "s1", "text_a"), "s1").join(own(t, "t", "text_b"), "t").select("s1", "t", "text_a", "text_b")


# --- sources, sinks, checks, profiles ------------------------------------------------------------------------


@query("er_id_lists", _with(*P_SQL, _ASSIGNED) + " SELECT r.entity_id AS source1_entity_id, coalesce(string_agg(a.t, ',' ORDER BY a.t), '') AS matched_entity_ids FROM rec r LEFT JOIN assigned a ON a.s1 = r.entity_id WHERE starts_with(r.entity_id, 'S1-') GROUP BY r.entity_id")
def er_id_lists(spark, sf_dir):
    return K.id_lists(sides(records(spark, sf_dir))[0], D.assign(probabilities(spark, sf_dir), 0.7))


@query("er_tsv_round_trip", f"WITH {RECORDS_SQL} SELECT entity_id, nullif(regexp_replace(business_name, '[\\t\\r]', ' ', 'g'), '') AS business_name, regexp_replace(business_address, '[\\t\\r]', ' ', 'g') AS business_address, country FROM rec")
def er_tsv_round_trip(spark, sf_dir):
    """Records written as tab-separated text and read again."""
    d = records(spark, sf_dir)
    path = f"{fresh_folder(spark)}/records.tsv"
    K.write_tsv(d.select(*[F.regexp_replace(c, "[\\t\\r]", " ").alias(c) for c in d.columns]), path)
    return SRC.canonical(SRC.read_tsv(spark, path)).select(*SRC.RECORD)


@query("er_truth_pairs", _with(RECORDS_SQL, TRUTH_SQL) + " SELECT g.s1, g.t, r.country AS c1 FROM truth g JOIN rec r ON r.entity_id = g.s1")
def er_truth_pairs(spark, sf_dir):
    d = records(spark, sf_dir)
    s1, t = sides(d)
    return SRC.truth_pairs(K.id_lists(s1, truth(d)), s1, t)


#: Faults put into a list file: repeated rows, repeated ids, own side, unknown ids, missing and extra rows.
FAULTS_SQL = f"""WITH {RECORDS_SQL.strip()}, {TRUTH_SQL.strip()}, need AS (SELECT entity_id FROM rec WHERE starts_with(entity_id, 'S1-')),
g AS (SELECT s1, list(t ORDER BY t) AS ids FROM truth GROUP BY s1), base AS (SELECT entity_id AS s1, coalesce(ids, []) AS ids FROM need LEFT JOIN g ON g.s1 = need.entity_id),
lists AS (SELECT s1, CASE WHEN length(s1) % 4 = 0 THEN list_concat(ids, ids) WHEN length(s1) % 4 = 1 THEN list_append(ids, s1) WHEN length(s1) % 4 = 2 THEN list_append(ids, 'X-' || s1) ELSE list_append(ids, 'S2-none') END AS ids FROM base WHERE NOT ends_with(s1, '-3') UNION ALL SELECT s1, ids FROM base WHERE ends_with(s1, '-4') UNION ALL SELECT 'S1-extra', []),
i AS (SELECT s1, unnest(ids) AS x FROM lists),
bad AS (SELECT DISTINCT * FROM (SELECT 'duplicate_row' AS rule, s1 AS x FROM lists GROUP BY s1 HAVING count(*) > 1 UNION ALL SELECT 'repeated_id', s1 FROM lists WHERE len(ids) <> len(list_distinct(ids)) UNION ALL SELECT 'missing_row', entity_id FROM need WHERE entity_id NOT IN (SELECT s1 FROM lists)
  UNION ALL SELECT 'unknown_row', s1 FROM lists WHERE s1 NOT IN (SELECT entity_id FROM need) UNION ALL SELECT 'self_match', x FROM i WHERE starts_with(x, 'S1-') UNION ALL SELECT 'wrong_prefix', x FROM i WHERE NOT starts_with(x, 'S1-') AND NOT starts_with(x, 'S2-') AND NOT starts_with(x, 'S3-')
  UNION ALL SELECT 'unknown_id', x FROM i WHERE (starts_with(x, 'S2-') OR starts_with(x, 'S3-')) AND x NOT IN (SELECT entity_id FROM rec)))
SELECT rule, 'error' AS severity, count(*)::BIGINT AS n_offenders, array_to_string(list_sort(list(x))[1:5], ',') AS examples FROM bad GROUP BY rule"""


@query("er_validate", FAULTS_SQL)
def er_validate(spark, sf_dir):
    d = records(spark, sf_dir)
    s1, t = sides(d)
    base = V.lists_of(K.id_lists(s1, truth(d)))
    n, ids = F.length("s1") % 4, F.col("ids")
    broken = F.when(n == 0, F.concat(ids, ids)).when(n == 1, F.array_append(ids, F.col("s1"))).when(n == 2, F.array_append(ids, F.concat(F.lit("X-"), "s1"))).otherwise(F.array_append(ids, F.lit("S2-none")))
    lists = base.filter(~F.endswith("s1", F.lit("-3"))).select("s1", broken.alias("ids")).unionByName(base.filter(F.endswith("s1", F.lit("-4")))).unionByName(spark.range(1).select(F.lit("S1-extra").alias("s1"), F.array().cast("array<string>").alias("ids")))
    return V.check_lists(lists, "matching", s1, t.select("entity_id")).select("rule", "severity", "n_offenders", F.array_join("examples", ",").alias("examples"))


@query("er_truth_profile", _with(RECORDS_SQL, TRUTH_SQL) + ", n AS (SELECT entity_id, count(g.t) AS k FROM rec r LEFT JOIN truth g ON g.s1 = r.entity_id WHERE starts_with(entity_id, 'S1-') GROUP BY entity_id) SELECT k::BIGINT AS matches, count(*)::BIGINT AS entities, round(100 * count(*) / (SELECT count(*) FROM n), 2)::DOUBLE AS percent FROM n GROUP BY k")
def er_truth_profile(spark, sf_dir):
    d = records(spark, sf_dir)
    return A.truth_profile(SRC.truth_lists(K.id_lists(sides(d)[0], truth(d))))


@query("er_conflicts", _with(*P_SQL) + " SELECT t, count(DISTINCT s1)::BIGINT AS queries FROM pp GROUP BY t HAVING count(DISTINCT s1) > 1")
def er_conflicts(spark, sf_dir):
    return A.conflicts(candidates(spark, sf_dir))


@query("er_countries", f"WITH {RECORDS_SQL} SELECT CASE WHEN trim(coalesce(country, '')) = '' THEN '<EMPTY>' ELSE trim(country) END AS country, count(*)::BIGINT AS records FROM rec GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def er_countries(spark, sf_dir):
    """The twelve most frequent labels, a report that is a top list by its nature."""
    return A.countries(records(spark, sf_dir))


@query("er_scripts", rf"""WITH {RECORDS_SQL} SELECT count(*)::BIGINT AS names, count(*) FILTER (length(regexp_replace(business_name, '[^{fixed.INDIC_CLASSIC}]', '', 'g')) / length(business_name) > 0.1)::BIGINT AS indic,
  count(*) FILTER (length(regexp_replace(business_name, '[^{fixed.LATIN_EXTENDED}]', '', 'g')) / length(business_name) > 0.05)::BIGINT AS latin_ext FROM rec WHERE business_name <> ''""")
def er_scripts(spark, sf_dir):
    return A.scripts(records(spark, sf_dir))


@query("er_exact_copies", f"WITH {RECORDS_SQL}, g AS (SELECT count(*) AS n FROM rec GROUP BY business_name, business_address, country) SELECT sum(n)::BIGINT AS records, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS copies FROM g")
def er_exact_copies(spark, sf_dir):
    return A.exact_copies(records(spark, sf_dir))


@query("er_file_profile", "SELECT 'documents' AS file, true AS present, (SELECT count(*) FROM documents)::BIGINT AS rows UNION ALL SELECT 'customer', true, (SELECT count(*) FROM customer) UNION ALL SELECT 'ground_truth', false, 0")
def er_file_profile(spark, sf_dir):
    return A.file_profile({"documents": documents(spark, sf_dir), "customer": spark.read.parquet(f"{sf_dir}/customer.parquet"), "ground_truth": None})
