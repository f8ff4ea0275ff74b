from pyspark.sql import functions as F

from topicloom.functions import labels as lb
from topicloom.functions import text as tx
from topicloom.functions.wordlists import PLACEHOLDERS_LOOSE, PLACEHOLDERS_STRICT, strong_stopwords


def run(spark, values, expression, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_light_cleaning(spark):
    given = ["a b http://x y", "<p>Hallo</p>", "x 1 ab", "", None, " \t\n", "Größe é2 ẞ me@x.de ok", "www.a.b c9"]
    want = ["", "hallo", "1 ab", "", "", "", "größe 2 ok", "c9"]
    assert run(spark, given, tx.clean_light(F.col("t"))) == want


def test_unicode_space_ends_a_url(spark):
    assert run(spark, ["http://x yy zz"], tx.clean_light(F.col("t"))) == ["yy zz"]


def test_case_is_kept_on_request(spark):
    assert run(spark, ["Die Lampe A 7"], tx.clean_light(F.col("t"), lowercase=False)) == ["Die Lampe 7"]


def test_strong_cleaning_keeps_repeats_and_drops_digits_and_short_words(spark):
    got = run(spark, ["Bitte Lampe Lampe 123 a1b ab defekt und Straße 12x"], tx.clean_strong(F.col("t"), strong_stopwords()))
    assert got == ["lampe lampe a1b defekt 12x"]


def test_ngrams(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "t array<string>")
    got = [r[0] for r in df.select(tx.ngrams(F.col("t"))).collect()]
    assert got == [[], ["a"], ["a", "b", "a b"], ["a", "b", "c", "a b", "b c"]]


def test_placeholders(spark):
    given = ["x", None, "  ", " NULL", "None", " nan\t", ""]
    strict = run(spark, given, tx.is_real_text_strict(F.col("t"), PLACEHOLDERS_STRICT))
    loose = run(spark, given, tx.is_real_text_loose(F.col("t"), PLACEHOLDERS_LOOSE))
    assert [bool(x) for x in strict] == [True, False, False, False, False, False, False]
    assert loose == [True, False, False, True, False, False, False]


def test_blank(spark):
    assert run(spark, ["", None, " \t", "x"], tx.is_blank(F.col("t"))) == [True, True, True, False]


def test_filter_does_not_copy_the_cleaning(spark):
    from topicloom.plans.pipeline import clean_corpus

    df = spark.createDataFrame([(1, "Lampe defekt")], "id int, t string")
    plan = clean_corpus(df, "id", "t", ["und"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_labels(spark):
    assert run(spark, ["\"Defekte Lampe\"", " '\"x\"' ", "'a' "], lb.clean_label(F.col("t"))) == ["Defekte Lampe", "\"x\"", "a"]
    got = run(spark, ["English: broken lamp", "TRANSLATION:a, b", "note: x", "a, b", "", "Übel"], lb.clean_translation(F.col("t")))
    assert got == ["Broken lamp", "a, b", "Note: x", "a, b", "", "Übel"]
    assert run(spark, ["-1_rest", "3_a_b", "plain", "x_1"], lb.label_prefix(F.col("t"))) == ["-1", "3", None, None]
    assert run(spark, ["-1_rest", "3_a_b", "plain", "x_1"], lb.label_body(F.col("t"))) == ["rest", "a_b", "plain", "x_1"]


def test_reconcile_keywords(spark):
    df = spark.createDataFrame(
        [([("a", 1.0), ("b", 0.5)], ["x"]), ([("a", 1.0), ("b", 0.5)], ["x", "y"]), ([("a", 1.0), ("b", 0.5)], ["x", "y", "z"])],
        "o array<struct<word:string,score:double>>, t array<string>",
    )
    got = [[tuple(p) for p in r[0]] for r in df.select(lb.reconcile_keywords(F.col("o"), F.col("t"))).collect()]
    assert got == [[("x", 1.0), ("b", 0.5)], [("x", 1.0), ("y", 0.5)], [("x", 1.0), ("y", 0.5)]]


def test_numbered_list_cuts_each_text(spark):
    df = spark.createDataFrame([(["abcdef", "x"],)], "t array<string>")
    assert df.select(tx.numbered_list(F.col("t"), 3)).first()[0] == "1. abc\n2. x"


def test_email_pattern_in_linear_time_matches_the_plain_one():
    import random
    import re
    import time

    plain, fast = (re.compile(p.replace("(?U)", "")) for p in (tx.EMAIL, tx.EMAIL_RUN))
    rng = random.Random(3)
    for _ in range(30_000):
        text = "".join(rng.choice("ab@@.. \u00a0\né") for _ in range(rng.randint(0, 14)))
        assert fast.sub("|", text) == plain.sub("|", text), text
    start = time.time()
    for text in ("a" * 400_000 + " x@", "@" * 400_000, "a@" * 200_000, "." * 400_000 + "@", "a@b" * 100_000):
        fast.sub("|", text)
    assert time.time() - start < 2


def test_long_runs_with_an_at_sign_stay_linear(spark):
    import time

    df = spark.createDataFrame([("x" * n + " me@home.de " + "@" * n,) for n in (40_000, 400_000)], "t string")
    df.select(tx.strip_emails(F.lit("a@b.c"))).collect()
    start = time.time()
    out = [r[0] for r in df.select(tx.strip_emails(F.col("t"))).collect()]
    assert time.time() - start < 10
    assert [len(o) for o in out] == [2 * 40_000 + 3, 2 * 400_000 + 3]
