"""Validation of id-list files; each rule is an aggregate or an anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.records import exists, read_ids

MATCHING = ("source1_entity_id", "matched_entity_ids")
CANDIDATE = ("source1_entity_id", "candidate_entity_ids")
EXAMPLES = 5
RULE = "file string, rule string, severity string, n_offenders long, examples array<string>"


def _found(offenders: DataFrame, file: str, rule: str, severity: str) -> DataFrame:
    """One row if there are offenders (a column ``x``, distinct), else none."""
    one = offenders.select(F.col("x").cast("string").alias("x")).distinct()
    n = one.agg(F.count("*").alias("n_offenders"))
    shown = one.orderBy("x").limit(EXAMPLES).agg(F.sort_array(F.collect_list("x")).alias("examples"))
    return n.crossJoin(shown).filter("n_offenders > 0").select(F.lit(file).alias("file"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n_offenders", "examples")


def lists_of(df: DataFrame) -> DataFrame:
    """(s1, ids) of a file's two columns; a blank list is empty, items are taken as they are."""
    a, b = df.columns[:2]
    rest = F.coalesce(F.col(f"`{b}`"), F.lit(""))
    return df.select(F.col(f"`{a}`").alias("s1"), F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ",", -1)).alias("ids"))


def check_lists(lists: DataFrame, file: str, required: DataFrame, valid: DataFrame | None = None, prefixes: bool = True) -> DataFrame:
    """The format's rules over (s1, ids) as rows (file, rule, severity, n_offenders, examples)."""
    ids = lists.select("s1", F.explode("ids").alias("x"))
    own, need = lists.select(F.col("s1").alias("x")).distinct(), required.select(F.col("entity_id").alias("x")).distinct()
    good = F.startswith("x", F.lit("S2-")) | F.startswith("x", F.lit("S3-"))
    rules = [
        (lists.groupBy(F.col("s1").alias("x")).count().filter("count > 1"), "duplicate_row"),
        (lists.filter(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("s1").alias("x")), "repeated_id"),
        (need.join(own, "x", "left_anti"), "missing_row"),
        (own.join(need, "x", "left_anti"), "unknown_row"),
    ]
    if prefixes:
        rules += [(ids.filter(F.startswith("x", F.lit("S1-"))), "self_match"), (ids.filter(~good & ~F.startswith("x", F.lit("S1-"))), "wrong_prefix")]
    if valid is not None:
        rules.append((ids.filter(good).join(valid.select(F.col("entity_id").alias("x")), "x", "left_anti"), "unknown_id"))
    out = None
    for offenders, rule in rules:
        row = _found(offenders, file, rule, "error")
        out = row if out is None else out.unionByName(row)
    return out


def outside_candidates(matches: DataFrame, candidates: DataFrame, severity: str = "warning") -> DataFrame:
    """Queries with a match that is no candidate of theirs."""
    long = lambda d: d.select("s1", F.explode("ids").alias("t")).distinct()
    return _found(long(matches).join(long(candidates), ["s1", "t"], "left_anti").select(F.col("s1").alias("x")), "matching", "not_a_candidate", severity)


def check_file(spark: SparkSession, path: str, header: tuple[str, str], required: DataFrame, valid: DataFrame | None, file: str) -> tuple[DataFrame, DataFrame | None]:
    """(findings, lists); a broken file has one finding and no lists.

    Lines are read as text, so that one without a tab is found and not filled up.
    """

    def broken(rule: str, example: str) -> tuple[DataFrame, None]:
        return spark.createDataFrame([(file, rule, "error", 1, [example])], RULE), None

    if not exists(spark, path):
        return broken("no_file", path)
    # One column, so that each line stays whole; the first line of each part is its header, any other like it is a row.
    lines = spark.read.csv(path, sep="\u0001", header=True, quote="", inferSchema=False)
    if not lines.columns:
        return broken("empty_file", path)
    head = lines.columns[0]
    if "\t" not in head and "," in head:
        return broken("comma_separated", head)
    if tuple(c.strip().lower() for c in head.split("\t")) != header:
        return broken("header", head)
    body = lines.toDF("value", *lines.columns[1:]).select(F.regexp_replace("value", "\r$", "").alias("value"))
    lists = lists_of(body.filter(F.contains("value", F.lit("\t"))).select(F.substring_index("value", "\t", 1).alias("a"), F.expr("substring(value, instr(value, '\t') + 1)").alias("b")))
    bad = _found(body.filter(~F.contains("value", F.lit("\t")) & (F.trim("value") != "")).select(F.col("value").alias("x")), file, "no_tab", "error")
    return bad.unionByName(check_lists(lists, file, required, valid)), lists


def validate(spark: SparkSession, matching: str, candidates: str | None, source1: str, targets: tuple[str, ...] = (), check_ids: bool = True, strict: bool = False) -> DataFrame:
    """All findings. Matches outside the candidates are warned of; with ``strict`` they are errors, and
    prefixes and known ids are asked of candidates alone. A missing candidate file is a warning."""
    from kinfold.sources.records import read_tsv

    if not exists(spark, source1):
        return spark.createDataFrame([("source1", "no_file", "error", 1, [source1])], RULE)
    required = read_ids(read_tsv(spark, source1))
    valid, out = None, spark.createDataFrame([], RULE)
    if check_ids and targets:
        gone = [t for t in targets if not exists(spark, t)]
        if gone:
            out = out.unionByName(spark.createDataFrame([("targets", "no_file", "warning", len(gone), gone)], RULE))
        else:
            for t in targets:
                own = read_ids(read_tsv(spark, t))
                valid = own if valid is None else valid.unionByName(own)
    found, matches = check_file(spark, matching, MATCHING, required, None if strict else valid, "matching")
    out = out.unionByName(found.filter(~F.col("rule").isin("self_match", "wrong_prefix")) if strict else found)
    if candidates and exists(spark, candidates):
        found, lists = check_file(spark, candidates, CANDIDATE, required, valid, "candidate")
        out = out.unionByName(found)
        if matches is not None and lists is not None:
            out = out.unionByName(outside_candidates(matches, lists, "error" if strict else "warning"))
    elif candidates:
        out = out.unionByName(spark.createDataFrame([("candidate", "no_file", "error" if strict else "warning", 1, [candidates])], RULE))
    return out


def passed(findings: DataFrame) -> bool:
    return not findings.filter("severity = 'error'").take(1)


def raise_if_broken(findings: DataFrame) -> None:
    """For callers that want an exception rather than a table."""
    bad = findings.filter("severity = 'error'").limit(20).collect()
    if bad:
        raise AssertionError("; ".join(f"{r.file}: {r.rule} ({r.n_offenders}, e.g. {', '.join(r.examples)})" for r in bad))
