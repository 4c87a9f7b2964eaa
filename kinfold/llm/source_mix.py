"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Only DataFrame functions. Sizes are summed per source, targets are shared by weight under a cap, and
whole blocks of a fixed number of words go to sources by the highest quotients size / (2k + 1). Each
source's documents are dealt over shards by a seeded hash and laid end to end there; the source's
blocks go to its shards by the same rule, so each shard has an integer quota that it fills on its own:
all its blocks as often as they fit, the rest by a seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm._common import stored

APPENDED = ("size", "source_size", "target", "taken")


@dataclass(frozen=True)
class Mix:
    """``weights`` name sources (None: the null source); others get 1, 2, 3, repeating in code-point order."""

    block_words: int = 64
    shard_words: int = 50_000
    shards: int = 10_000  # of a source at most; beyond, shards get larger
    most: int = 3  # times a source's or document's size
    seed: int = 17
    weights: dict[str | None, float] = field(default_factory=dict)


def word_count(text: Column) -> Column:
    """How many runs of characters other than space and U+0009 to U+000D; a null has none."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    # a word starts where the text starts or a space comes before a letter
    return F.coalesce(F.size(F.filter(F.split(plain, " "), lambda w: w != "")), F.lit(0)).cast("long")


def _highest_quotients(df: DataFrame, share: str, seats: str, group: str | None, order: str) -> DataFrame:
    """Append ``quota``: Sainte-Lague seats of each row for its exact ``share`` of ``seats``.

    ``order`` breaks ties. A row's quota lies near its share: when rows number r, the divisor moves by
    r / (2 * seats) at most, so only the quotients that near are listed and ranked.
    """
    w = Window.partitionBy(*([group] if group else []))
    near = df.withColumn("__near", F.ceil(F.col(share) * F.count("*").over(w) / F.greatest(F.col(seats), F.lit(1))) + 2)
    near = near.withColumn("__low", F.greatest(F.lit(0), F.floor(F.col(share)) - F.col("__near")).cast("long"))
    near = near.withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    listed = near.select("*", F.explode(F.sequence(F.col("__low"), (F.floor(F.col(share)) + F.col("__near")).cast("long"))).alias("__k"))
    by = Window.partitionBy(*([group] if group else [])).orderBy(F.desc(F.col(share) / (2 * F.col("__k") + 1)), order, "__k")
    won = listed.withColumn("__won", ((F.row_number().over(by) <= F.col("__left")) & (F.col(share) > 0)).cast("long"))
    keys = df.columns
    return won.groupBy(*keys).agg((F.first("__low") + F.sum("__won")).cast("long").alias("quota"))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """From (source, source_size): append ``rank``, ``weight`` and ``target``.

    All sizes are shared by weight; no target is above ``most`` times its source, and what is over is
    shared again by weight. Sources in order of size per weight are capped first, so the level of the
    others follows from running sums, without iteration.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = ((F.col("rank") - 1) % 3 + 1).cast("double")
    for name, w in mix.weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    cap = (F.col("source_size") * mix.most).cast("double")
    df = ranked.withColumn("weight", weight).withColumn("__cap", cap)
    by = Window.orderBy(F.col("__cap") / F.col("weight"), "rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    done = by.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(done), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(done), F.lit(0.0)))
    # the level once all sources before this one are capped; the first that it doesn't exceed fixes it
    df = df.withColumn("__level", level)
    df = df.withColumn("__level", F.min(F.when(F.col("__level") * F.col("weight") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("weight"), F.col("rank"), F.col("__level")))).over(every)["__level"])
    return df.withColumn("target", F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("weight"), F.col("__cap")))).drop("__cap", "__level")


def _sized(docs: DataFrame, row: Column, id_column: str, text: str, source: str, mix: Mix) -> DataFrame:
    """(row, source, h, size), stored, so that the texts are split once."""
    h = F.xxhash64(F.lit(mix.seed), F.col(id_column))
    return stored(docs.select(row.alias("row"), F.col(source).alias("source"), h.alias("h"), word_count(F.col(text)).alias("size")), "sizes", lasting=True)


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """Append ``size``, ``source_size``, ``target`` and ``taken`` (words taken, repeats counted).

    A null text has size 0 and nothing is taken of it; a null source is a source, the last. Repeated
    rows are documents of their own. A run on the same rows takes the same words. Columns of these
    four names are replaced, even that of the text, and all others kept; an empty table gives an empty
    result.
    """
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in APPENDED]
    return _mixed(_sized(docs, F.struct(*docs.columns), id_column, text, source, mix), mix).select(*kept, *APPENDED)


def _mixed(sized: DataFrame, mix: Mix) -> DataFrame:
    """From (row, source, h, size): (row, size, source_size, target, taken)."""
    b = mix.block_words
    hashed = sized.select(F.col("source").alias("__source"), F.col("h").alias("__h"), "size", F.col("row").alias("__row"))
    sizes = hashed.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, mix)
    total = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    plan = plan.withColumn("__blocks", F.round(total / b).cast("long"))
    plan = plan.withColumn("__share", F.col("target") / b)
    quotas = _highest_quotients(plan.select("source", "rank", "source_size", "target", "__blocks", "__share"), "__share", "__blocks", None, "rank")
    quotas = quotas.select("source", "rank", "source_size", "target", F.col("quota").alias("__quota"), F.least(F.lit(mix.shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / mix.shard_words))).cast("long").alias("__shards"))
    placed = hashed.join(quotas, hashed["__source"].eqNullSafe(quotas["source"])).drop("source")
    placed = placed.withColumn("__shard", F.pmod(F.xxhash64(F.lit(mix.seed + 1), "__h"), F.col("__shards")))
    shards = placed.groupBy("rank", "__shard").agg(F.sum("size").alias("__size"), F.first("__quota").alias("__quota"), F.first("source_size").alias("source_size"))
    shards = shards.withColumn("__share", F.col("__quota") * F.col("__size") / F.greatest(F.col("source_size"), F.lit(1)))
    per_shard = _highest_quotients(shards.select("rank", "__shard", "__size", "__quota", "__share"), "__share", "__quota", "rank", "__shard")
    per_shard = per_shard.select("rank", "__shard", F.col("quota").alias("__own"), F.col("__size"), F.greatest(F.lit(1), F.round(F.col("__size") / b)).cast("long").alias("__has"))
    # documents of a shard end to end in seeded order; the line is cut into blocks of as near b words as leaves no rest
    line = Window.partitionBy("rank", "__shard").orderBy("__h", "size", F.xxhash64("__row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("__end", F.sum("size").over(line)).withColumn("__at", F.row_number().over(line))
    laid = laid.join(per_shard, ["rank", "__shard"])
    long = F.greatest(F.col("__size"), F.lit(1))
    block = lambda p: F.floor(((p + 1) * F.col("__has") - 1) / long).cast("long")  # noqa: E731  that word p lies in
    starts = lambda k: F.floor(k * F.col("__size") / F.col("__has")).cast("long")
    first, last = block(F.col("__end") - F.col("size")), block(F.col("__end") - 1)
    whole = F.floor(F.col("__own") / F.col("__has")).cast("long")
    rest = F.pmod(F.col("__own"), F.col("__has"))
    laid = laid.withColumn("__whole", F.least(whole, F.lit(mix.most))).withColumn("__rest", F.when(whole >= mix.most, F.lit(0)).otherwise(rest))
    # The rest: a seeded rotation of an even spacing picks __rest of the __has blocks.
    turn = F.pmod(F.xxhash64(F.lit(mix.seed + 2), "rank", "__shard"), F.col("__has"))
    picked = lambda n: F.floor((n + turn) * F.col("__rest") / F.col("__has"))
    overlap = lambda k: F.least(F.col("__end"), starts(k + 1)) - F.greatest(F.col("__end") - F.col("size"), starts(k))
    chosen = lambda k: (picked(k + 1) - picked(k)).cast("long")
    extra = F.when(F.col("size") > 0, F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, k: acc + overlap(k) * chosen(k))).otherwise(F.lit(0).cast("long"))
    taken = (F.col("size") * F.col("__whole") + extra).cast("long")
    return laid.select(F.col("__row").alias("row"), "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The mixture as whole documents, with the columns they came with.

    A document is there taken / size times, rounded up or down by a seeded draw whose mean is that
    quotient, so sources keep their shares; documents without words are not in a mixture. Rows that
    share an id share a draw, null ids included. Only ids and sizes take part in the mixing itself.
    """
    narrow = _sized(docs, F.struct(F.col(id_column).alias("id")), id_column, text, source, mix)
    draw = (F.pmod(F.xxhash64(F.lit(mix.seed + 3), "id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    taken = _mixed(narrow, mix).groupBy("row.id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).filter("size > 0")
    times = taken.select(F.col("id").alias("__id"), F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias("__times")).filter("__times > 0")
    return docs.join(times, docs[id_column].eqNullSafe(times["__id"])).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: nulls, ties, repeats and an empty table as in ``mix_sources``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = _sized(docs, F.struct("doc_id"), "doc_id", "text", "source", Mix())
    return _mixed(sized, Mix()).select("row.doc_id", *APPENDED)
