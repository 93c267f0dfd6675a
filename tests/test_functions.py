"""Column expressions against values worked out by hand."""

import datetime
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from itemloom.functions import codes, text, values


def apply(spark, f, inputs, schema="x string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, " + schema)
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_description(spark):
    given_ = ["Café  de São Paulo 500g!", "de para com", "Nº 5", "Straße ½ ﬁno ™", "A AS O x", "", None]
    assert apply(spark, text.normalize_description, given_) == [
        "CAFE SAO PAULO 500G", None, "N 5", "STRASSE 1 2 FINO TM", "X", None, None,
    ]
    app = apply(spark, lambda c: text.normalize_description(c, text.APP), given_)
    assert app == ["CAFE SAO PAULO 500G", "", "5", "STRASSE 1 2 FINO TM", "X", "", ""]


def brute_description(value, variant):
    folded = text.without_accents(value.upper()) if variant == text.PIPELINE else text.without_accents(value).upper()
    words = [w for w in re.sub(r"[^A-Z0-9\s]", " ", folded).split() if w not in text.STOPWORDS]
    return " ".join(words) or (None if variant == text.PIPELINE else "")


@pytest.mark.parametrize("variant", [text.PIPELINE, text.APP])
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(inputs=st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), min_size=50, max_size=200))
def test_description_of_any_text(spark, variant, inputs):
    got = apply(spark, lambda c: text.normalize_description(c, variant), inputs)
    assert got == [brute_description(x, variant) for x in inputs]


def test_every_character_folds(spark):
    chars = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i <= 0xDFFF]
    chunks = ["x" + "-".join(chars[i : i + 64]) + "x" for i in range(0, len(chars), 64)]
    for variant in (text.PIPELINE, text.APP):
        got = apply(spark, lambda c: text.normalize_description(c, variant), chunks)
        assert got == [brute_description(x, variant) for x in chunks]


def test_unit(spark):
    given_ = ["pç", "Unid.", "xyz", "", None, "KG.", "caixa", " l "]
    assert apply(spark, text.normalize_unit, given_) == ["PC", "UN", "XYZ", None, None, "KG", "CX", "LT"]


def test_strip_keeps_empty(spark):
    assert apply(spark, text.strip, ["  a b\t", " ", None]) == ["a b", "", None]


def test_natural_order(spark):
    order = lambda c: text.natural_sorted(c)
    assert apply(spark, order, [["a10", "a2", "b", "A1"]], "x array<string>") == [["A1", "a2", "a10", "b"]]
    big = ["9" * 41, "1" + "0" * 41, "2", "a", "", "1a", "01"]
    assert apply(spark, order, [big], "x array<string>")[0] == ["", "01", "1a", "2", "9" * 41, "1" + "0" * 41, "a"]


def test_word_count_and_escape(spark):
    assert apply(spark, text.word_count, ["A B  C ", "", None]) == [3, 0, 0]
    assert apply(spark, text.html_escape, ["<a href=\"x\">&'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"]


def test_gtin(spark):
    given_ = ["7891234567895", "7891234567890", "123", "00000000", None, "", "789-1234567895", "10614141000415"]
    assert apply(spark, codes.valid_gtin, given_) == [
        "7891234567895", None, None, "00000000", None, None, "7891234567895", "10614141000415",
    ]


def test_gtin_against_brute_force(spark):
    import random

    rng = random.Random(7)
    given_ = ["".join(rng.choices("0123456789", k=rng.choice([7, 8, 12, 13, 14, 15]))) for _ in range(3000)]

    def valid(code):
        if len(code) not in (8, 12, 13, 14):
            return None
        total = sum(int(d) * (3 if i % 2 == 0 else 1) for i, d in enumerate(code[-2::-1]))
        return code if (10 - total % 10) % 10 == int(code[-1]) else None

    assert apply(spark, codes.valid_gtin, given_) == [valid(c) for c in given_]


def test_ncm_cest_and_sort_value(spark):
    assert apply(spark, codes.valid_ncm, ["1234.56.78", "123", None]) == ["12345678", None, None]
    assert apply(spark, codes.valid_cest, ["12.345.67", "123456"]) == ["1234567", None]
    assert apply(spark, codes.numeric_sort_value, ["A10B2", "ABC", None]) == [102.0, float("inf"), float("inf")]


def test_code_entries(spark):
    got = apply(spark, codes.parse_code_entry, ["[A; 3]", "B", "[bad", "[ x ;12] tail"])
    assert [tuple(r) for r in got] == [("A", 3), ("B", 1), ("[bad", 1), ("x", 12)]
    entry = lambda c: codes.code_entry(c, F.lit(7))
    assert apply(spark, entry, ["K", ""]) == ["[K; 7]", "[; 7]"]
    numbered = lambda c: codes.split_code(F.lit("K"), c)
    assert apply(spark, numbered, [1, 123], "x int") == ["K_separado_01", "K_separado_123"]


@pytest.mark.parametrize("value, expected", [
    ("12.345.678/0001-90", "12345678000190"), ("12345678000190", "12345678000190"), ("12.345abc", "12345"),
])
def test_taxpayer_id(spark, value, expected):
    assert codes.required_taxpayer_id(value) == expected
    assert apply(spark, codes.taxpayer_id, [value]) == [expected]


@pytest.mark.parametrize("value", [None, "", "abc"])
def test_taxpayer_id_invalid(spark, value):
    with pytest.raises(ValueError, match="taxpayer id"):
        codes.required_taxpayer_id(value)
    assert apply(spark, codes.taxpayer_id, [value]) == [None]


def test_taxpayer_id_strict(spark):
    assert apply(spark, lambda c: codes.taxpayer_id(c, True), ["12.345.678/0001-90", "123"]) == ["12345678000190", None]


def test_lenient_values(spark):
    number = lambda c: values.lenient_double(c, T.StringType())
    assert apply(spark, number, ["1,5", "1d", " 2.5 ", None, "1e3", "-.5", "x"]) == [0, 0, 2.5, 0, 1000, -0.5, 0]
    number = lambda c: values.lenient_double(c, T.DoubleType())
    assert apply(spark, number, [float("nan"), 1.5, None], "x double") == [0, 1.5, 0]
    assert apply(spark, values.compact_date, ["31122023", "99999999", "x", None]) == [
        datetime.date(2023, 12, 31), None, None, None,
    ]
    assert apply(spark, values.br_date, ["31/12/2023", "2023-12-31"]) == [datetime.date(2023, 12, 31), None]
    micros = lambda c: values.wall_micros(values.lenient_timestamp(c))
    assert apply(spark, micros, ["1970-01-02 00:00:00.000001", "1969-12-31 23:59:59", "x"]) == [86400000001, -1000000, None]


def test_exact_sum_in_any_order(spark):
    df = spark.createDataFrame([(x,) for x in [0.1] * 10 + [1e30, -1e30, 0.2]], "x double")
    assert df.agg(values.exact_sum(F.col("x"))).first()[0] == 1.2
    assert df.limit(0).agg(values.exact_sum(F.col("x"))).first()[0] is None


def test_sums_keep_small_digits(spark):
    df = spark.range(1000).select((F.lit(1e-11) + 0 * F.col("id")).alias("x"))
    assert abs(df.agg(values.exact_sum(F.col("x"))).first()[0] - 1e-8) < 1e-20


def test_decimal_text(spark):
    rows = spark.sql("select cast(x as decimal(38,10)) d, cast(x as decimal(38,0)) w from values ('7891234567895'), ('100'), ('0'), ('-1.50'), (null) t(x)")
    got = [tuple(r) for r in rows.select(values.decimal_text(F.col("d")), values.decimal_text(F.col("w"))).collect()]
    assert got == [("7891234567895", "7891234567895"), ("100", "100"), ("0", "0"), ("-1.5", "-2"), (None, None)]


def test_counts_of_any_length_keep_their_weight(spark):
    got = apply(spark, codes.parse_code_entry, ["[A; 99999999999999999999]", "[B; " + "9" * 50 + "]"])
    assert [int(r.n) for r in got] == [99999999999999999999, int("9" * 30)]


def test_display_cells(spark):
    df = spark.sql("select array('a', null, 'b') l, cast(null as string) n, true t, 3 i, 1.5D d")
    from itemloom.operators.report import display_cells

    assert tuple(display_cells(df).first()) == ("a, b", "", "true", "3", "1.5")


def test_numbers_and_times_as_text(spark):
    numbers = [0.0, 1.0, -1.5, 1e7, 12345678.9, 0.1, 1e-4, 0.00012345678901234567, 1e-5, 1.5e-7, 9999999999999998.0, 1e16,
               1.25e300, -2e-100, 123456789012345.67, float("inf"), float("-inf"), float("nan"), None]
    show = lambda c: values.display_cell(c, T.DoubleType())
    assert apply(spark, show, numbers, "x double") == ["" if n is None else str(n) for n in numbers]
    times = [datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 4, 5, 120000)]
    show = lambda c: values.display_cell(c, T.TimestampNTZType())
    assert apply(spark, show, times, "x timestamp_ntz") == [str(t) for t in times]
