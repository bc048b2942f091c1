import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from samewise.functions.unicode_forms import LATIN_LOOKALIKES, fold_letters, fold_width, plain_letters
from samewise.operators.quantities import _HAN, _READING, _UNIT, contents, han_number, p6_contents, p6_found, printed_error, readings, solve

UNITS = [("mg", "g", 0.001), ("g", "g", 1.0), ("kg", "g", 1000.0), ("oz", "g", 28.3495), ("lb", "g", 453.592), ("ml", "ml", 1.0), ("cl", "ml", 10.0), ("l", "ml", 1000.0), ("floz", "ml", 29.5735), ("pc", "pc", 1.0)]
FACTORS = {u: (b, f) for u, b, f in UNITS}


@pytest.mark.parametrize(
    ("text", "uom", "qty"),
    [
        ("Soap 90g×3 【送15g旅行裝】", "g", 90),
        ("6件共300g (每件50g)", "g", 50),
        ("共200ml(100毫升×2)", "ml", 100),
        ("500g*3=1500g", "g", 500),
        ("2.1oz/60g單件", "g", 60),
        ("250ml/8.45fl oz×2", "ml", 250),
        ("1,500ml x 3件", "ml", 1500),
        ("0,05 kg一件裝", "g", 50),
        ("¼磅", "g", 113),
        ("1½ lb", "g", 680),
        ("半公斤1件", "g", 500),
        ("一百六十五克", "g", 165),
        ("200g±5%", "g", 200),
        ("４.76 оz. 6-Pack", "g", 135),
        ("30 sheets", "pc", 30),
        ("No.K200ALC-310 / 310ml / HOT", "ml", 310),
        ("250cc", "ml", 250),
    ],
)
def test_golden(text, uom, qty):
    got = solve(readings(fold_letters(text.replace("½", " ½"))), FACTORS)
    assert (got[0], round(got[1])) == (uom, qty)


@pytest.mark.parametrize("text", ["", "24小時出貨", "送試用裝15ml", "長8x寬6x高3厘米", "#K8007L650", "No. 9", "350", "9入"])
def test_no_content(text):
    assert solve(readings(fold_letters(text)), FACTORS) is None


def test_two_amounts_that_fit_no_identity_are_flagged():
    assert solve(readings("100g 170g"), FACTORS)[3] is False


def test_no_cap_on_amounts_or_pieces():
    amounts = readings("5.7oz 5.75oz 5.78oz 5.79oz 5.81oz 5.83oz 5.82oz 165g")
    assert len(amounts) == 8 and round(solve(amounts, FACTORS)[1]) == 165
    assert solve(readings(fold_letters("共7200g / 100g")), FACTORS)[:2] == ("g", 100.0)  # 72 pieces
    many = readings(" ".join(f"{i}g" for i in range(1, 900)))
    assert len(many) == 899 and solve(many, FACTORS) is not None


def test_printed_errors():
    err = lambda t: printed_error(readings(t), FACTORS, solve(readings(t), FACTORS)[1])
    assert err("165g") == 0.5 and abs(err("0.17kg") - 5) < 1e-9 and abs(err("5.8oz") - 0.05 * 28.3495) < 1e-9 and abs(err("1/2 lb") - 0.25 * 453.592) < 1e-9


def test_other_columns_decide_between_readings(spark):
    ref = spark.createDataFrame(UNITS, "unit_code string, base_uom string, factor double")
    df = spark.createDataFrame([("100g 170g", "170g"), ("100g 170g", None), ("100g 170g", "皂")], "a string, b string")
    got = [(r.content.qty, r.content.is_unique) for r in contents(df, ["a", "b"], ref).collect()]
    assert got == [(170.0, True), (100.0, False), (100.0, False)]


def test_han_numbers():
    assert [han_number(x) for x in ("十", "一百三十五", "一千", "二百五十", "兩", "一萬二千")] == [10, 135, 1000, 250, 2, 12000]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_folding_is_idempotent_and_reading_never_fails(text):
    assert fold_width(fold_width(text)) == fold_width(text)
    solve(readings(fold_letters(text)), FACTORS)


def test_found_and_edge_cases(spark):
    ref = spark.createDataFrame(UNITS, "unit_code string, base_uom string, factor double")
    schema = "sku_id string, sku_name_chi string, pack_size_chi string, content string"
    listings = spark.createDataFrame([("a", "皂 60g", "90g", "x"), ("a", "皂 60g", "90g", "x"), ("b", "皂", "90g", None), ("c", None, None, None), ("d", "", " ", None), (None, "1g", None, None), ("e", "皂 " * 50000 + "75克", None, None)], schema)
    groups = spark.createDataFrame([("a", "500"), ("b", "1.5 litre"), ("c", None)], "sku_id string, unit string")
    got = {tuple(r) for r in p6_found(listings, groups, ref).collect()}
    assert got == {("listings", "a", "g", 60), ("listings", "b", "g", 90), ("listings", "e", "g", 75), ("sku_groups", "b", "ml", 1500)}
    assert {(r.rec_table, r.sku_id, r.is_unique) for r in p6_contents(listings, groups, ref).collect()} == {(a, b, True) for a, b, _, _ in got}
    # a clashing column is replaced, others stay; an empty table stays empty
    out = contents(listings, ["sku_name_chi"], ref)
    assert out.columns == ["sku_id", "sku_name_chi", "pack_size_chi", "content"]
    assert p6_found(listings.limit(0), groups.limit(0), ref).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("0159,./⁄ 半三十百gGmlkox克片ａ９½", max_size=24))
def test_amounts_are_found_as_by_the_plain_pattern(text):
    number = rf"(?:\d+ )?\d{{1,2}}[/⁄]\d{{1,2}}(?!\d)|\d+(?:[.,]\d+)*|半|[{_HAN}]+"
    plain = re.compile(rf"(?<![a-z0-9.,])({number}) ?({_UNIT})(?:\.(?!\d))?(?![a-wyz]|x[a-z])(?:/(?=\d))?", re.I)
    assert [(m.span(), m.groups()) for m in _READING.finditer(text)] == [(m.span(), m.groups()) for m in plain.finditer(text)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=12) | st.text("АЁѐΆёοg９ ﬁΩ\u0301", max_size=12))
def test_letters_are_folded_as_by_the_plain_way(text):
    folded = fold_width(text)
    want = unicodedata.normalize("NFC", unicodedata.normalize("NFD", folded).translate(str.maketrans(LATIN_LOOKALIKES)))
    assert fold_letters(text) == (folded if folded.isascii() else want)
    assert fold_letters(folded) == folded or not plain_letters(folded)


@settings(max_examples=200, deadline=None)
@given(st.text(" \t\n\x1c\x85\u00a0\u2003\u3000a克", max_size=12))
def test_spaces_are_folded_as_by_the_plain_way(text):
    assert fold_width(text) == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()
