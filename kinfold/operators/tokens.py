"""Record views: tokens, keys, bags, the learnt dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import extract as X
from kinfold.functions import fixed
from kinfold.functions import text as N


#: Keeps the components of an address apart while their text is decomposed in one piece.
PART = "\u0001"


def record_cache(df: DataFrame) -> DataFrame:
    """The classic view of a record: normalised texts, tokens, codes and scripts, in 21 columns."""
    raw = df.select("entity_id", N.text_or_empty(F.col("business_name")).alias("raw_name"), N.text_or_empty(F.col("business_address")).alias("raw_addr"), N.country_code(F.col("country"), fixed.CACHE_COUNTRIES).alias("country"))
    clean = raw.select("*", N.classic_clean(F.col("raw_name")).alias("__n"), N.classic_clean(F.col("raw_addr")).alias("__a"))
    d = clean.select("entity_id", "raw_name", "raw_addr", "country", N.classic_name(F.col("__n")).alias("norm_name"), N.classic_address(F.col("__a")).alias("norm_addr"))
    d = d.withColumns({"sort_name": N.sorted_tokens(F.col("norm_name")), "sort_addr": N.sorted_tokens(F.col("norm_addr")), "norm_name_tokens": N.tokens(F.col("norm_name")), "norm_addr_tokens": N.tokens(F.col("norm_addr"))})
    code = F.coalesce(X.postal_code(F.col("raw_addr"), F.col("country")), F.lit(""))
    return d.select(
        "*", F.size("norm_name_tokens").alias("name_len"), F.size("norm_addr_tokens").alias("addr_len"), code.alias("postal"), F.substring(code, 1, 3).alias("postal_3"),
        F.coalesce(X.street_number(F.col("raw_addr"), F.col("country")), F.lit("")).alias("st_num"), F.coalesce(F.try_element_at("norm_name_tokens", F.lit(1)), F.lit("")).alias("first_tok"), N.acronym(F.col("norm_name_tokens")).alias("acronym"),
        *[X.script_share(F.col("raw_name"), k).cast("float").alias(f"script_{k}") for k in ("indic", "ascii", "latin_ext")], X.script_type(F.col("raw_name")).alias("script_type"),
    )


def learn_dictionary(pairs: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(token, latin): native tokens and the Latin ones that true pairs put in their place.

    ``pairs``: n1, n2, a1, a2. Names of as many tokens are aligned by position; a native token of an
    address goes with each state of the other address. All occurrences count for the total, whatever
    they were aligned with. Ties go to the smaller Latin token.
    """
    indic = f"[{fixed.INDIC}]"
    native = lambda c: F.rlike(c, F.lit(indic))
    names = pairs.filter(native(N.text_or_empty(F.col("n2")))).select(N.tokens(N.plain_clean(F.col("n1"))).alias("x"), N.tokens(N.plain_clean(F.col("n2"))).alias("y"))
    aligned = names.filter(F.size("x") == F.size("y")).select(F.explode(F.arrays_zip("x", "y")).alias("z")).select(F.col("z.y").alias("token"), F.col("z.x").alias("latin"))
    aligned = aligned.filter(native(F.col("token")) & ~native(F.col("latin")))
    places = pairs.filter(native(N.text_or_empty(F.col("a2")))).select(F.array_distinct(N.tokens(N.plain_address(F.col("a1")))).alias("x"), N.tokens(N.plain_address(F.col("a2"))).alias("y"))
    places = places.select(F.filter("x", lambda t: F.startswith(t, F.lit("_st_"))).alias("x"), F.explode("y").alias("token")).filter(native(F.col("token")))
    partners = aligned.unionByName(places.select("token", F.explode("x").alias("latin")))
    totals = aligned.select("token").unionByName(places.select("token")).groupBy("token").agg(F.count("*").alias("total"))
    best = partners.groupBy("token", "latin").agg(F.count("*").alias("n")).groupBy("token").agg(F.min(F.struct((-F.col("n")).alias("m"), "latin")).alias("b"))
    good = best.join(totals, "token").select("token", F.col("b.latin").alias("latin"), (-F.col("b.m")).alias("n"), "total")
    return good.filter((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("token", "latin")


def dictionary_column(learnt: DataFrame, most: int = 200_000) -> Column | None:
    """The dictionary as a map literal; its size is checked, since every task gets it."""
    rows = learnt.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the dictionary has more than {most} tokens; join it instead")
    return N.table_of({r.token: r.latin for r in rows}) if rows else None


def record_tokens(df: DataFrame, learnt: Column | None = None, alias_countries: bool = False) -> DataFrame:
    """The accent-free view: ``ntok_all``, ``ntok``, ``atok``, ``abig``, ``nm``, ``ad``, ``num``, ``states``.

    State rules know the labels US, India and France; with ``alias_countries`` other names of these
    countries count as well. The record's own columns are kept.
    """
    label = F.col("country")
    if alias_countries:
        code = N.country_code(F.col("country"))
        label = F.when(code == "US", "US").when(code == "IN", "India").when(code == "FR", "France").otherwise(F.col("country"))
    d = df.withColumn("__c", label).withColumn("__comps", F.split(F.translate(N.text_or_empty(F.col("business_address")), PART, " "), ",", -1))
    d = _clean_each(d, "__comps").withColumn("__raw", N.tokens(N.plain_clean(F.col("business_name"))))
    d = d.withColumn("__at", N.address_tokens(F.col("__comps"), F.col("__c"), learnt))
    french = F.col("__c") == "France"
    name = F.col("__raw") if learnt is None else N.map_tokens(F.col("__raw"), learnt)
    d = d.withColumn("atok", F.when(french, N.map_tokens(F.col("__at"), fixed.FRENCH_ADDRESS)).otherwise(N.map_tokens(F.col("__at"), fixed.ADDRESS)))
    d = d.withColumn("ntok_all", F.when(french, N.map_tokens(name, fixed.FRENCH_NAMES)).otherwise(name))
    own = d.select(
        *df.columns, "ntok_all", "atok", X.first_number(F.col("business_address")).alias("num"),
        F.array_sort(F.array_distinct(F.filter("atok", lambda x: F.startswith(x, F.lit("_st_"))))).alias("states"),
    )
    return unpacked(own)


def packed(tokens: DataFrame) -> DataFrame:
    """``record_tokens`` as they are stored: without what ``unpacked`` makes of the rest."""
    return tokens.drop("ntok", "abig", "nm", "ad")


def unpacked(df: DataFrame) -> DataFrame:
    own = ("ntok_all", "atok", "num", "states")
    d = df.withColumn("ntok", F.filter("ntok_all", lambda x: ~x.isin(fixed.LEGAL_WORDS)))
    return d.select(*[c for c in df.columns if c not in own], "ntok_all", "ntok", "atok", N.bigrams(F.col("atok")).alias("abig"), F.array_join("ntok_all", " ").alias("nm"), F.array_join("atok", " ").alias("ad"), "num", "states")


def _clean_each(d: DataFrame, column: str) -> DataFrame:
    """Clean every item of an array; decomposing is one Arrow call on the joined text."""
    joined = N.nfkd(F.replace(F.array_join(column, PART), F.lit("&"), F.lit(" and ")))
    return d.withColumn(column, F.split(joined, PART, -1)).withColumn(column, F.transform(column, N.plain_decomposed))


@dataclass(frozen=True)
class Channel:
    """A bag of tokens to block on: a name, the highest document frequency of a token, and a weight."""

    name: str
    cap: int
    weight: float = 1.0


def name_bag() -> Column:
    """Words, the words glued together, and 4-grams of these."""
    glued = F.array_join("ntok", "")
    return F.concat(F.transform("ntok", lambda x: F.concat(F.lit("n:"), x)), F.array(F.concat(F.lit("n:"), glued)), F.transform(N.grams(glued), lambda x: F.concat(F.lit("c:"), x)))


def address_bag() -> Column:
    """Words and their bigrams, made here since blocking's tokens are stored without them."""
    return F.concat(F.transform("atok", lambda x: F.concat(F.lit("a:"), x)), F.transform(N.bigrams(F.col("atok")), lambda x: F.concat(F.lit("b:"), x)))


#: Channel name to its bag; more can be registered.
BAGS = {"name": name_bag, "addr": address_bag}


def channel_tokens(df: DataFrame, channels: tuple[Channel, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(entity_id, channel, token): the distinct tokens of a record's bags that hold more than their mark."""
    bags = [F.struct(F.lit(c.name).alias("channel"), F.filter(F.array_distinct(BAGS[c.name]()), lambda x: F.length(x) > 2).alias("bag")) for c in channels]
    long = df.select("entity_id", *keep, F.explode(F.array(*bags)).alias("b"))
    return long.select("entity_id", *keep, "b.channel", F.explode("b.bag").alias("token"))


def record_view(df: DataFrame) -> DataFrame:
    """What comparing a pair needs of each record, from ``record_tokens``."""
    flags = X.legal_flags(F.col("business_name"), F.col("ntok_all"), F.col("country"))
    return df.select(
        "entity_id", "nm", F.array_join("ntok", " ").alias("nk"), "ntok", F.array_join("ntok", "").alias("ng"), "ad",
        F.filter("atok", lambda x: F.rlike(x, F.lit("^\\p{Nd}+$"))).alias("nums"), F.try_element_at(F.filter("atok", lambda x: F.startswith(x, F.lit("_st_"))), F.lit(1)).alias("st"), F.col("num").alias("num1"),
        X.address_missing(F.col("business_address")).alias("a_null"), X.is_indic(F.col("business_name")).alias("n_nonlatin"), X.looks_like_domain(F.col("business_name")).alias("n_domain"),
        F.size("ntok").alias("n_len"), X.digit_runs(F.col("business_address")).alias("dig"), *[c.alias(k) for k, c in flags.items()], F.size("atok").alias("a_len"),
    )


def name_counts(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(country, nk, nk_cnt_s1, nk_cnt_t): how many records of either side share a name key."""
    key = F.array_join("ntok", " ").alias("nk")
    a = s1.select("country", key, F.lit(1).alias("x"), F.lit(0).alias("y"))
    b = targets.select("country", key, F.lit(0).alias("x"), F.lit(1).alias("y"))
    return a.unionByName(b).groupBy("country", "nk").agg(F.sum("x").alias("nk_cnt_s1"), F.sum("y").alias("nk_cnt_t"))

