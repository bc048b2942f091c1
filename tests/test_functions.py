import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samewise.functions import extract as X
from samewise.functions import text as T


def one(spark, value, *columns, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(*columns).first()


def test_text_columns(spark):
    r = one(
        spark,
        "Rose Soap 玫瑰香皂 100g x 6 (送起泡袋) 現貨",
        T.nfkc(F.lit("Ｓｏａｐ：　９０g")).alias("nfkc"),
        T.clean_title("t").alias("clean"),
        T.packfree("t").alias("packfree"),
        T.fold("t").alias("fold"),
        T.residual("t", F.lit("Rose")).alias("residual"),
        T.tokens(F.lit("海藻礦物泥 kelp 香皂 90g"), F.lit(None).cast("string")).alias("tokens"),
        T.char_ngrams(F.lit("ab-AB c")).alias("grams"),
        T.char_ngrams(F.lit("a")).alias("none"),
        T.tail_text(F.lit("brand - soap: 玫瑰味")).alias("tail"),
        T.lcp_ratio(F.lit("Rose soap"), F.lit("rose-soda")).alias("lcp"),
        T.lcp_ratio(F.lit(None).cast("string"), F.lit("x")).alias("nolcp"),
        T.display_width(F.lit("皂a")).alias("width"),
        F.array(*[T.plain_number(F.lit(x)) for x in (100.0, 2.5, 0.05)]).alias("numbers"),
        T.labelled_text(("A", F.lit(" x ")), ("B", F.lit("")), ("C", F.lit(None).cast("string"))).alias("lines"),
        T.hashed_terms(F.lit("ab ab")).alias("terms"),
    )
    assert r.nfkc == "Soap: 90g" and r.clean == "Rose Soap 玫瑰香皂 100g x 6" and r.packfree == "Rose Soap 玫瑰香皂"
    assert r.fold == "rosesoap玫瑰香皂100gx6送起泡袋現貨" and r.residual == "玫瑰"
    assert r.tokens == sorted({"kelp", *("海藻礦物泥"[i : i + n] for n in (2, 3, 4) for i in range(6 - n))})
    assert r.grams == ["ab", "ba", "bc"] and r.none == [] and r.tail == "玫瑰味"
    assert r.lcp == 6 / 8 and r.nolcp == 0 and r.width == 3 and r.numbers == ["100", "2.5", "0.05"] and r.lines == "A: x"
    assert sorted(r.terms) == sorted(["w:ab", "w:ab", "c2:ab", "c2:ba", "c2:ab", "c3:aba", "c3:bab", "c4:abab"])


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=30))
def test_nfkc_is_idempotent(text):
    assert T.nfkc_text(T.nfkc_text(text)) == T.nfkc_text(text)


def test_naming_helpers():
    assert T.intervals(["abc", "bcd", "x"], "abcd-abc x") == [(0, 4), (5, 8), (9, 10)]
    windows = ["橄欖油乳", "欖油乳木", "油乳木果"]
    assert T.phrases(windows, ["天然橄欖油乳木果皂"]) == ["橄欖油乳木果"]
    assert T.phrases(["橄欖油乳", "油乳木果"], ["橄欖油乳 油乳木果"]) == ["橄欖油乳", "油乳木果"]  # a glued form that no text has
    assert T.phrases(["橄欖", "橄欖油"], []) == ["橄欖油"] and T.phrases(["玫瑰"], ["皂"]) == ["玫瑰"]
    assert T.variant_label(["玫瑰", "薰衣草", "法國"], prefer={"玫瑰"}, limit=1) == "玫瑰"
    assert T.variant_label(["玫瑰", "法國"], exclude=["法國"]) == "玫瑰" and T.variant_label(["法國"], exclude=["法國"]) == "法國" and T.variant_label([]) == ""


def test_plain_signs():
    assert T.nfkc_text("【新】★皂「限」—Ａ！") == "[新] 皂[限]-A!" and T.nfkc_text(None) == ""


def test_codes(spark):
    rows = [("9349254002011", True), ("9349254002012", False), ("934925400201", False), (None, False), ("", False), ("93492540020１1", False)]
    got = spark.createDataFrame(rows, "c string, ok boolean").select(X.ean13_valid("c").alias("v"), "ok").collect()
    assert all(r.v == r.ok for r in got)
    r = one(spark, "K1_S_9349254002011_x", X.eans("t", F.lit("see 9349254002011 and 19349254002011 or 4006381333931")).alias("e"), X.short_codes(F.lit("#3288 (02059) [86017] 7777")).alias("s"))
    assert r.e == ["4006381333931", "9349254002011"] and r.s == ["02059", "3288", "86017"]


@pytest.mark.parametrize(
    ("text", "value", "uom", "n"),
    [("皂 100g x 6", 100, "g", 6), ("4 x 0.1kg", 100, "g", 4), ("長8x寬6x高3厘米 200毫升", 200, "ml", None), ("3.5oz", 99.22, "g", None), ("24小時", None, None, None), ("", None, None, None)],
)
def test_unit(spark, text, value, uom, n):
    r = one(spark, text, X.unit_of(F.col("t")).alias("u"))
    assert (r.u is None and value is None) or (r.u.value, r.u.uom, r.u.n) == (value, uom, n)


@pytest.mark.parametrize(("text", "n"), [("皂 100g x 6", 6), ("4 x 100g", 4), ("三件裝 皂", 3), ("皂 12個裝", 12), ("*隨機* 150g", 1), ("soap pack of 3", 3), ("x 150g", 1), ("", 1)])
def test_pack_count(spark, text, n):
    assert one(spark, text, X.pack_count("t", F.lit(None).cast("string")).alias("n")).n == n


def test_form_origin_brand(spark):
    r = one(
        spark,
        "手工皂 (送起泡袋)",
        X.form_of(F.col("t"), F.lit("")).alias("f"),
        X.form_of(F.lit("x"), F.lit("沐浴露")).alias("g"),
        X.form_of(F.lit(""), F.lit(None).cast("string")).alias("h"),
        X.origins(F.lit("日本/ 南韓、日本")).alias("o"),
        X.origins(F.lit(None).cast("string")).alias("none"),
        F.array(*[X.brand_key(F.lit(x)) for x in ("L'Occitane & Co.", "阿滿代購", "N/A", "")]).alias("b"),
    )
    assert (r.f.form, r.f.conf) == ("soap_bar", 1.0) and (r.g.form, r.g.conf) == ("body_wash", 0.6) and (r.h.form, r.h.source) == ("UNKNOWN", None)
    assert r.o == ["日本", "韓國"] and r.none == [] and r.b == ["loccitaneco", "", "", ""]


def test_compatibility_treats_missing_as_wildcard(spark):
    n, s = F.lit(None).cast("double"), F.lit(None).cast("string")
    d, e = F.lit(100.0), F.array().cast("array<string>")
    r = one(
        spark,
        "",
        F.array(
            X.unit_compatible(n, s, n, s),
            X.unit_compatible(d, F.lit("g"), n, s),
            X.unit_compatible(d, F.lit("g"), F.lit(110.0), F.lit("g")),
            X.unit_compatible(d, F.lit("g"), F.lit(120.0), F.lit("g")),
            X.unit_compatible(d, F.lit("g"), d, F.lit("ml")),
            X.unit_compatible(F.lit(0.0), F.lit("g"), F.lit(0.0), F.lit("g")),
            X.unit_candidate_compatible(d, F.lit("g"), n, s),
            X.origin_compatible(e, F.array(F.lit("a"))),
            X.origin_compatible(F.array(F.lit("b")), F.array(F.lit("a"))),
            X.form_compatible(F.lit("UNKNOWN"), F.lit("x")),
        ).alias("a"),
    )
    assert r.a == [True, False, True, False, False, True, True, True, False, True]


def test_propagation(spark):
    rows = [("a", ["4006381333931"], [], "x", 1), ("b", [], ["3931"], "x", 2), ("c", [], ["33931"], "y", 3), ("d", [], ["333931"], "", 4), ("e", [], [], "x", 5)]
    df = spark.createDataFrame(rows, "sku_id string, ean array<string>, codes array<string>, brand_key string, row_ord long")
    got = {r.sku_id: (r.ean_all, r.ean_source) for r in X.propagate_eans(df).collect()}
    code = ["4006381333931"]
    assert got == {"a": (code, "direct"), "b": (code, "propagated"), "c": ([], None), "d": (code, "propagated"), "e": ([], None)}
