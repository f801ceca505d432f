import datetime

import pytest
from pyspark.sql import functions as F

from rivulet.functions import names as N
from rivulet.functions import text as X
from rivulet.sources.county import tokenize


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("raw", "name", "tag"), [("Harbor Fund PAC (PAC)", "Harbor Fund PAC", "PAC"), ("  Harbor (cce) ", "Harbor", "CCE"), ("Harbor (XYZ)", "Harbor (XYZ)", None), ("(PAC)", "", "PAC")])
def test_split_type_tag(spark, raw, name, tag):
    bare, got = N.split_type_tag(F.lit(raw))
    assert tuple(one(spark, bare, got)) == (name, tag)


@pytest.mark.parametrize(("raw", "normal"), [("SECURE FLORIDA'S FUTURE", "SECURE FLORIDAS FUTURE"), ("Müller & Söhne", "MULLER AND SOHNE"), ("X'STEP", "X STEP"), ("Straße, Inc. (PAC)", "STRASSE INC"), ("  ", ""), ("a\tb", "A B"), ("Éa ñ", "EA N")])
def test_normalize_name(spark, raw, normal):
    assert one(spark, N.normalize_name(F.lit(raw)))[0] == normal


def test_with_normalized_takes_other_scripts_too(spark):
    df = spark.createDataFrame([("ﬁne Ⅳ",), ("plain",), (None,)], "s string")
    assert {r["s"]: r["n"] for r in N.with_normalized(df, "s", "n").collect()} == {"ﬁne Ⅳ": "FINE IV", "plain": "PLAIN", None: None}


def test_blocking_keys(spark):
    a, b = one(spark, N.blocking_key(F.lit("Friends of Jane Doe")), N.blocking_key(F.lit("Jane Doe, Friends of")))
    assert a == b == "DOE FRIENDS JANE"
    assert one(spark, N.blocking_key(F.lit("The PAC of Inc")))[0] == "INC OF PAC THE"


@pytest.mark.parametrize(
    ("a", "b", "cut", "zip", "score"),
    [
        ("FLORIDA CHAMBER PAC", "Florida Chamber of Commerce PAC", False, None, 0.7667), ("Florida Chamber of Commerce Alliance, In", "Florida Chamber of Commerce Alliance, Inc.", True, None, 0.95),
        ("Florida Chamber of Commerce PAC", "Florida Chamber of Commerce CCE", False, None, 0.80), ("Florida Chamber of Commerce PAC", "Florida Chamber of Commerce CCE", False, "32301", 0.88),
        ("Florida Chamber of Commerce PAC", "Florida Chamber of Commerce Alliance, Inc.", False, None, 0.688), ("SECURE FLORIDA'S FUTURE", "Secure Florida's Future Inc.", False, None, 0.912), ("a", "A", False, None, 1.0),
    ],
)
def test_score_match(spark, a, b, cut, zip, score):
    z = F.lit(zip).cast("string")
    got = one(spark, N.score_match(F.lit(a), F.lit(b), cut, z, z)["score"])[0]
    assert got == pytest.approx(score, abs=5e-4)
    if zip:
        assert got >= N.AUTO_LINK  # equal keys at one ZIP link


def test_zip3_and_city(spark):
    a, b = F.lit("Alpha Beta Gamma"), F.lit("Alpha Beta Delta")
    plain = one(spark, N.score_match(a, b)["score"])[0]
    raised = one(spark, N.score_match(a, b, False, F.lit("32301"), F.lit("32302"), F.lit(" tampa"), F.lit("Tampa "))["score"])[0]
    assert raised == pytest.approx(plain + 0.07)


def test_strict_prefix(spark):
    long, short = F.lit("Florida Chamber of Commerce Political Committee"), F.lit("Florida Chamber of Commerce")
    assert one(spark, N.score_match(long, short, True)["score"])[0] == 0.95
    assert one(spark, N.score_match(long, short, True, strict_prefix=True)["score"])[0] < 0.95


def test_two_similarities_differ(spark):
    a, b = F.lit("FLORIDA CHAMBER"), F.lit("FLORIDA CHAMBER COMMERCE PAC")
    x, y = one(spark, N.string_similarity(a, b), N.word_similarity(a, b))
    assert (round(x, 4), round(y, 4)) == (0.5517, 0.5714)


def test_persons(spark):
    assert tuple(one(spark, N.looks_like_person(F.lit("SMITH, JOHN A")), N.looks_like_person(F.lit("Smith Trust, Bob")), N.display_name(F.lit("SMITH, JOHN A")), N.display_name(F.lit(" Acme ")))) == (True, False, "JOHN A SMITH", "Acme")


def test_cells(spark):
    assert X.decode_cell("Rhodesia &#34;Rho&#34; Butler<br/>x &amp;#34; &bogus; &nbsp; <b>y</b>&#0;") == 'Rhodesia "Rho" Butler x &#34; &bogus; y'
    day = lambda s: one(spark, X.normalize_date(F.lit(s)))[0]
    assert [day(s) for s in ("2024-01-15", "1/20/2024", "0000-00-00", "2026-02-30", "1799-01-01", "x")] == [datetime.date(2024, 1, 15), datetime.date(2024, 1, 20), None, None, None, None]
    money = lambda s: str(one(spark, X.clean_amount(F.lit(s)))[0])
    assert [money(s) for s in ("$1,000.00", "-12.345", "12a", "", "250000")] == ["1000.00", "-12.35", "None", "None", "250000.00"]
    shown = lambda x: one(spark, X.format_money(F.lit(x)))[0]
    assert [shown(x) for x in (0.0, 900.0, 1500.0, 1.25e6, 2.5e7, 3.21e9, -1500.0)] == ["$0", "$900", "$2K", shown(1.25e6), "$25M", "$3.2B", "$-1K"]
    assert one(spark, X.format_money_full(F.lit("-1234567.89").cast("decimal(16,2)")))[0] == "-$1,234,568"
    assert one(spark, X.fit_label(F.lit("x" * 40)))[0] == "x" * 37 + "…"


def test_tokenizer():
    assert tokenize('a,b\r\n"x ""y"" z",\r,,\n"p\nq",r"s"t') == [["a", "b"], ['x "y" z', ""], ["p\nq", "rst"]]
