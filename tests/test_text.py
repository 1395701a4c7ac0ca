from pyspark.sql import functions as F

from turnmill.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_times(spark):
    assert one(spark, X.minutes_seconds(F.lit(5332.9))) == "88:52"
    assert one(spark, X.hours_minutes_seconds(F.lit(5332.0))) == "01:28:52"
    assert one(spark, X.hours_minutes_seconds(F.lit(1626.0))) == "27:06"
    assert [one(spark, X.plain_seconds(F.lit(s))) for s in (12.0, 0.5, 1234.567, 100.0)] == ["12", "0.5", "1234.567", "100"]


def test_names(spark):
    cases = {"a/b:c?..": "a_b_c__", "a\tb\x01": "ab", "": "untitled", " .x. ": "x", "y" * 250: "y" * 200, "..": "_"}
    for given, want in cases.items():
        assert one(spark, X.file_name(F.lit(given))) == want
    assert one(spark, X.safe_title(F.lit("Ä b-c_d: e"))) == "Ä b-c_d_ e"
    assert one(spark, X.identifier(F.lit("--A b, c: (d)"))) == "A_b_c_d"
    assert one(spark, X.title_of_file(F.lit("A_ b_c"))) == "A b c"


def test_forms(spark):
    assert one(spark, X.normalized(F.lit("  A B\n\tc "))) == "a b c"
    assert one(spark, X.matchable(F.lit("a – b — c"))) == "a - b - c"
    assert one(spark, X.normalized_title(F.lit("A:  B"))) == "a b"
    assert one(spark, X.first_words(F.lit("a b  c d"), 3)) == "a b c" and one(spark, X.first_words(F.lit(" "))) == ""
    assert one(spark, X.preview(F.lit("abc"), 2)) == "ab..." and one(spark, X.preview(F.lit("ab"), 2)) == "ab"
    assert one(spark, X.bullets(F.array(F.lit("a"), F.lit("b")))) == "- a\n- b"
    assert one(spark, X.lexemes(F.lit("Don't STOP-été 7"))) == ["don", "t", "stop", "été", "7"]
