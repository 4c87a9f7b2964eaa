import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinfold.functions import extract as X
from kinfold.functions import fixed
from kinfold.functions import text as N


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_classic_clean(spark):
    got = col(spark, [None, "A & B's  Co.", "ﬁne ＡＢＣ", "Crème-Brûlée_x", "टाटा", "\t x \n"], N.classic_clean)
    assert got == ["", "a and b s co", "fine abc", "crème brûlée_x", "ट ट", "x"]
    assert col(spark, ["टाटा"], lambda c: N.classic_clean(c, True)) == ["टाटा"]
    for t in ["St-Honoré, 12/B", "a̐b", "x·y", "ⅷ"]:
        want = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", t).lower().replace("&", " and "))).strip()
        assert col(spark, [t], N.classic_clean) == [want]


def test_names_and_addresses(spark):
    assert col(spark, ["acme pvt ltd", "pvt ltd", "", "sa co x"], N.classic_name) == ["acme", "pvt ltd", "", "x"]
    assert col(spark, ["12 n main st", "5 r de rivoli", "2 nd ave"], N.classic_address) == ["12 north main street", "5 rue de rivoli", "2 north avenue"]
    assert col(spark, ["b a b", ""], N.sorted_tokens) == ["a b", ""]
    assert col(spark, [" usa ", "India", "U.S.", "Narnia", None, "germany"], N.country_code) == ["US", "IN", "US", "NARNIA", "", "DE"]
    assert col(spark, ["germany"], lambda c: N.country_code(c, fixed.CACHE_COUNTRIES)) == ["GERMANY"]


def test_plain_clean(spark):
    given = [None, "A&B", "Joe's Café", "33nd St, 0048", "1st 2nd 3rdx", "00", "Société Générale", "82/2C5", "टाटा मोटर्स", "  -- ", "x0012 0a"]
    assert col(spark, given, N.plain_clean) == ["", "a and b", "joes cafe", "33 st 48", "1 2 3rdx", "0", "societe generale", "82 2c5", "टाटा मोटर्स", "", "x0012 0a"]
    assert col(spark, ["1, West Virginia; virginia ave, new york"], N.plain_address) == ["1 _st_wv _st_va ave _st_ny"]


def test_grams_and_bigrams(spark):
    assert col(spark, ["abc", "abcd", "aaaaa", ""], N.grams) == [[], ["abcd"], ["aaaa"], []]
    assert col(spark, [["a"], ["a", "b", "c"], []], N.bigrams, "array<string>") == [[], ["a_b", "b_c"], []]


@pytest.mark.parametrize(
    "address,country,want",
    [("9 x 12345-6789", "US", "12345"), ("9 x 560001", "India", "560001"), ("75001 Paris", "France", "75001"), ("12345", "CHINA", None), ("123456", "CHINA", "123456"), ("12345", "Austria", "12345"), ("75001", "Africa", "75001"), ("12345 654321", "", "654321"), ("12345", None, "12345"), ("x12345", "US", None), (None, "US", None)],
)
def test_postal_code(spark, address, country, want):
    df = spark.createDataFrame([(address, country)], "a string, c string")
    assert df.select(X.postal_code(F.col("a"), F.col("c")).alias("x")).first().x == want


def test_numbers(spark):
    assert col(spark, ["12B Main 12345", "560001 12", None, "no", "123456 12345 7"], X.street_number) == ["12b", "12", None, None, "7"]
    assert col(spark, ["0048 x", "x", None, "00"], X.first_number) == ["48", None, None, "0"]
    assert col(spark, ["82/2C16 007", None], X.digit_runs) == [["82", "2", "16", "7"], []]
    assert col(spark, [None, "ab", "abc"], X.address_missing) == [True, True, False]
    assert col(spark, ["a.com", "WWW.x", "#tag", "@me", "x#", None], X.looks_like_domain) == [True, True, True, True, False, False]


def test_scripts(spark):
    assert col(spark, ["टाटा", "é", "abc", "", None, "abcdefghijklmnopqrstué"], X.script_type) == ["indic", "latin_accented", "ascii", "ascii", "ascii", "ascii"]
    assert col(spark, ["aé", ""], lambda c: X.script_share(c, "ascii")) == [0.5, 1.0]


def test_legal_flags(spark):
    rows = [("Acme Pvt Ltd", ["acme", "pvt", "ltd"], "India"), ("Dupont S.A.R.L.", [], "France"), ("Dupont SASU", [], "France"), ("Dupont s.a.s", [], "France"), ("Dupont SA", [], "France"), ("Dupont", ["sa"], "US")]
    df = spark.createDataFrame(rows, "n string, t array<string>, c string")
    got = [{k[3:] for k, v in r.asDict().items() if k.startswith("lg_") and v} for r in df.select("*", *[c.alias(k) for k, c in X.legal_flags(F.col("n"), F.col("t"), F.col("c")).items()]).collect()]
    assert got == [{"priv", "ltd"}, {"llc"}, {"corp"}, {"inc"}, {"ltd"}, {"fr"}]


def test_address_tokens(spark):
    rows = [("306 Massachusetts Avenue, X, OK", "US"), ("1 Rd, West Virginia", "US"), ("St-Nazaire, Loire-Atlantique", "France"), ("9, NCT of Delhi", "India"), ("a, TX", "Germany"), (None, "US")]
    df = spark.createDataFrame(rows, "a string, c string").withColumn("comps", F.transform(F.split(F.coalesce("a", F.lit("")), ","), lambda x: F.trim(F.lower(F.regexp_replace(x, "-", " ")))))
    got = [r.x for r in df.select(N.address_tokens(F.col("comps"), F.col("c")).alias("x")).collect()]
    assert got == [["306", "massachusetts", "avenue", "x", "_st_ok"], ["1", "rd", "_st_wv"], ["st", "nazaire", "_st_fr_pdl"], ["9", "_st_dl"], ["a", "tx"], []]


def test_lists_have_their_sizes():
    assert [len(x) for x in (fixed.LEGAL_SUFFIXES, fixed.CLASSIC_ADDRESS, fixed.COUNTRIES, fixed.LEGAL_WORDS, fixed.US_STATES, fixed.INDIAN_STATES, fixed.FRENCH_REGIONS, fixed.ADDRESS, fixed.GENERIC)] == [25, 36, 14, 53, 51, 35, 7, 57, 87]
