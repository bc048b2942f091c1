"""Contents stated in many units, brought to base units (problem 6).

A row states its content in one or more texts (title first). Each text is read into *readings*
(number, unit, role). Readings of one text constrain each other by physical identities:

* total = pieces x piece          ("3 x 165g = 495g", "495g in all (165g each)")
* metric amount = imperial amount  ("165g / 5.8oz", where a bare ounce may be mass or volume)
* mass = density x volume          (only for readings of different kinds of unit)

Where a number or unit can be read in several ways (``1,500`` as fifteen hundred or one and a half,
``oz`` as mass or volume, one of two amounts as the total), all combinations are scored by the sum of
the absolute log residuals of the identities, the smallest wins, and a row whose best combinations
lie within ``TIE`` of each other with different contents is flagged ``is_unique = false`` unless the
amounts in its other columns decide.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.functions.unicode_forms import fold_letters

# Written units and the unit code they stand for.
UNIT_WORDS = {
    "mg": "mg 毫克",
    "g": "g gr gm grams gram 克 公克 グラム",
    "kg": "kg kgs kilo kilogram kilograms 公斤 千克",
    "oz": "oz ounce ounces 安士 盎司",
    "lb": "lb lbs pound pounds 磅",
    "ml": "ml cc milliliter millilitre milliliters millilitres 毫升",
    "cl": "cl centiliter centilitre",
    "l": "l litre liter litres liters ltr 升 公升 リットル",
    "floz": "floz 液安士 液盎司",
    "pc": "pc pcs sheet sheets 片 張 张 枚",
}
IMPERIAL = {"oz", "lb", "floz"}
#: Relative gap within which two amounts count as the same one: a shop rounds 4.76 oz to 4.8 oz.
CLOSE = math.log(1.05)
TIE = 1e-3
#: Grams in a millilitre of what is sold by volume (water-based), for the mass-volume identity.
DENSITY = 1.0

_WORD = {w: code for code, words in UNIT_WORDS.items() for w in words.split()}
_UNIT = "|".join(["fl\\.? ?oz"] + [re.escape(w) for w in sorted(_WORD, key=lambda w: (-len(w), w))])
# Chinese numerals.
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2, "兩": 2}
_TENS = {"十": 10, "百": 100, "千": 1000, "萬": 10000, "万": 10000}
_HAN = "零〇一二三四五六七八九十百千萬万两兩"
# A written number by its first character, which begins the pattern: most places of a text are passed over without trying the rest.
_NUMBER = rf"[\d半{_HAN}](?<![a-z0-9.,].)(?:(?<=\d)(?:\d* \d{{1,2}}[/⁄]\d{{1,2}}(?!\d)|\d?[/⁄]\d{{1,2}}(?!\d)|\d*(?:[.,]\d+)*)|(?<=半)|(?<=[{_HAN}])[{_HAN}]*)"
_READING = re.compile(rf"({_NUMBER}) ?({_UNIT})(?:\.(?!\d))?(?![a-wyz]|x[a-z])(?:/(?=\d))?", re.I)
_GIFT = re.compile(r"[(【\[]?(?:加?[送贈赠附]|gift|free gift)[^)】\]/|,，;；]{0,12}?(?:體驗裝|体验装|旅行裝|旅行装|試用裝|试用装|sample|travel)(?: ?\d+(?:[.,]\d+)? ?[a-z]+)?[)】\]]?|(?:送|贈|赠)(?:試用|试用)[^ ]* ?\d* ?[a-z]*", re.I)
_GIVEN = re.compile("[送贈赠附]|gift", re.I)
_TOTAL_BEFORE = re.compile(r"(?:共|合共|合計|合计|總共|总共|總重|总重|total(?: of)?|=) ?$", re.I)
_EACH_BEFORE = re.compile(r"(?:每[件個个塊块支瓶包]|each|各) ?$", re.I)
_TOLERANCE_BEFORE = re.compile(r"(?:±|\+/-|誤差|误差) ?$")
_COUNT_AFTER = re.compile(r"^ ?(?:±\d+(?:\.\d+)?%)? ?(?:[x×*] ?(\d+)|(?:原箱)?(\d+) ?(?:件|盒|個|个|pack|-pack)|pack of (\d+)|(\d+)-pack)", re.I)
_COUNT_BEFORE = re.compile(r"(?<![a-z0-9])(\d+) ?(?:[x×*]|件共?|個共?) ?$", re.I)
_VULGAR = re.compile(r"(?<=\d)(?=[¼-¾⅐-⅞])")  # NFKC would glue 1½ into 11/2
_QUICK = re.compile(rf"[\d半{_HAN}]")


def han_number(text: str) -> float | None:
    """A Chinese numeral below 100,000; None where it is none."""
    total, digit = 0, None
    for c in text:
        if c in _TENS:
            total += (1 if digit is None else digit) * _TENS[c] if _TENS[c] < 10000 else 0
            if _TENS[c] == 10000:
                total = (total + (digit or 0) or 1) * 10000
            digit = None
        elif c in _DIGITS:
            if digit is not None:
                digit = digit * 10 + _DIGITS[c]
            else:
                digit = _DIGITS[c]
        else:
            return None
    return float(total + (digit or 0))


def number_readings(text: str) -> list[float]:
    """All ways to read a written number, the usual one first."""
    if text == "半":
        return [0.5]
    if text[0] in _HAN:
        n = han_number(text)
        return [] if n is None else [n]
    if "/" in text or "⁄" in text:
        whole, a, b = re.fullmatch(r"(?:(\d+) )?(\d+)[/⁄](\d+)", text).groups()
        return [float(whole or 0) + float(a) / float(b)] if float(b) else []
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", text):
        as_thousands = float(text.replace(",", ""))
        decimal = [float(text.replace(",", "."))] if text.count(",") == 1 and "." not in text else []
        return decimal + [as_thousands] if text.startswith("0") else [as_thousands, *decimal]
    if text.count(",") == 1 and "." not in text:
        return [float(text.replace(",", "."))]
    if re.fullmatch(r"\d+\.\d+|\d+", text):
        return [float(text)]
    if re.fullmatch(r"\d{1,3}(?:\.\d{3})+(?:,\d+)?", text):
        return [float(text.replace(".", "").replace(",", "."))]
    return []


def printed_step(text: str) -> float:
    """Half a unit of a written number's last digit: what its rounding may hide. Fractions are told to half of their smallest part."""
    if "/" in text or "⁄" in text:
        part = float(re.search(r"[/⁄](\d+)", text)[1])
        return 0.5 / part if part else 0.5
    decimals = re.search(r"[.,](\d+)$", text)
    return 0.25 if text == "半" else 0.5 * 10.0 ** -len(decimals[1]) if decimals else 0.5


def readings(text: str) -> list[dict]:
    """The amounts in a folded text, without gifts, samples, tolerances and shares; equal amounts count once."""
    if not text or not _QUICK.search(text):
        return []
    if _GIVEN.search(text):
        text = _GIFT.sub(" ", text)
    out, seen = [], set()
    for m in _READING.finditer(text):
        before, after = text[max(0, m.start() - 10) : m.start()], text[m.end() : m.end() + 24]
        if _TOLERANCE_BEFORE.search(before[-6:]):
            continue
        code = _WORD.get(m[2].lower()) or "floz"
        numbers = number_readings(m[1])
        if not numbers or numbers[0] <= 0:
            continue
        n = _COUNT_AFTER.match(after) or _COUNT_BEFORE.search(before[-8:])
        role = "total" if _TOTAL_BEFORE.search(before) else "each" if _EACH_BEFORE.search(before[-8:]) else ""
        one = {"numbers": numbers, "code": code, "role": role, "n": float(next(x for x in n.groups() if x)) if n else None, "step": printed_step(m[1])}
        if (key := (tuple(numbers), code, role, one["n"])) not in seen:
            seen.add(key)
            out.append(one)
    return out


def _gap(role: str, n: float | None, base: str, amount: float, other: str, told: float, density: float) -> float:
    """Log residual between a piece's amount and another reading: equal, a total of n pieces, or mass = density x volume."""
    if other == base:
        gap = math.log(told / amount)
    elif {other, base} == {"g", "ml"}:
        gap = math.log(told / amount / density) if other == "g" else math.log(told / amount * density)
    else:
        gap = 3.0
    if role == "total" or (n and gap > CLOSE):
        counts = [n] if n else {max(2.0, math.floor(math.exp(min(gap, 700)))), max(2.0, math.ceil(math.exp(min(gap, 700))))}
        gap = min((gap - math.log(m) for m in counts if m > 0), key=abs, default=gap)
    return min(abs(gap), 3.0)


def solve(found: list[dict], factors: dict[str, tuple[str, float]], density: float = DENSITY, beside: list[dict] | None = None) -> tuple[str, float, float, bool] | None:
    """(base unit, amount of one piece, residual, unique) of the combination with the least log residuals.

    Given the piece, the readings of all other amounts are independent of each other, so each takes its own least residual: the sum is the least over
    all combinations, in time quadratic in a text's different amounts and without a bound on their number. ``beside`` are amounts of the record's other
    texts: they add residuals but are no pieces themselves.
    """
    found = [r for r in found if r["code"] in factors]
    if not found:
        return None
    beside = [r for r in beside or [] if r["code"] in factors]
    if len(found) == 1 and not beside and len(found[0]["numbers"]) == 1 and found[0]["role"] != "total":
        base, factor = factors[found[0]["code"]]
        return base, found[0]["numbers"][0] * factor, 0.0, True
    metric_oz = any(factors[r["code"]][0] == "ml" and r["code"] not in IMPERIAL for r in found)
    ways = []
    for r in [*found, *beside]:
        codes = [r["code"]] + (["floz"] if r["code"] == "oz" and metric_oz and "floz" in factors else [])
        ways.append([(factors[c][0], v * factors[c][1], c, i + j) for i, v in enumerate(r["numbers"]) for j, c in enumerate(codes)])
    only_totals = all(r["role"] == "total" for r in found)
    best: list[tuple[float, int, str, float]] = []
    for piece, r in enumerate(found):
        if r["role"] == "total" and not only_totals:
            continue
        for base, amount, code, rarity in ways[piece]:
            residual, rare = 0.0, rarity
            for k, other in enumerate([*found, *beside]):
                if k != piece:
                    gap, way = min((_gap(other["role"], other["n"] or r["n"], base, amount, b, a, density), w) for b, a, _, w in ways[k])
                    residual, rare = residual + gap, rare + way
            # metric before imperial, the marked piece before others, usual readings before rare ones, earlier before later
            best.append((residual, (code in IMPERIAL) * 1000 + (r["role"] != "each") * 100 + rare * 10 + piece, base, amount))
    least = min(b[0] for b in best)
    chosen = min((b for b in best if b[0] <= least + CLOSE), key=lambda b: (b[1], b[0]))
    unique = all(abs(math.log(b[3] / chosen[3])) <= CLOSE and b[2] == chosen[2] for b in best if b[0] <= least + TIE)
    if only_totals:
        n = next((r["n"] for r in found if r["n"]), None)
        return (chosen[2], chosen[3] / n, chosen[0], True) if n else (chosen[2], chosen[3], chosen[0], False)
    return chosen[2], chosen[3], chosen[0], unique


def printed_error(found: list[dict], factors: dict[str, tuple[str, float]], amount: float) -> float:
    """How far the amount, in base units, may be from the true one by the rounding of its finest printed form; infinite where it is not printed itself."""
    steps = [r["step"] * factors[r["code"]][1] for r in found if r["code"] in factors for v in r["numbers"] if abs(v * factors[r["code"]][1] - amount) <= 1e-9 * amount]
    return min(steps, default=math.inf)


SCHEMA = "source int, uom string, qty double, residual double, is_unique boolean"


def _solver(factors: dict[str, tuple[str, float]], density: float):
    def one(texts: tuple) -> tuple:
        for k, text in enumerate(texts):
            if text and (got := solve(found := _read(text), factors, density)):
                if not got[3]:  # the columns are amounts of one thing: what the others say decides between readings that fit alike
                    beside = [r for j, t in enumerate(texts) if j != k and t for r in _read(t)]
                    got = solve(found, factors, density, beside) if beside else got
                return (k, *got)
        return (None, None, None, None, None)

    def run(*columns: pd.Series) -> pd.DataFrame:
        rows = [one(texts) for texts in zip(*columns, strict=True)]
        return pd.DataFrame(rows, columns=["source", "uom", "qty", "residual", "is_unique"]).astype({"source": "Int32"})

    return run


def _read(text: str) -> list[dict]:
    return readings(fold_letters(_VULGAR.sub(" ", text)))


def unit_factors(unit_ref: DataFrame) -> dict[str, tuple[str, float]]:
    """unit_code -> (base unit, factor). The reference of units is a code list; more than 1,000 rows are refused."""
    rows = unit_ref.select("unit_code", "base_uom", "factor").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("the reference of units has over 1,000 rows")
    return {r[0]: (r[1], float(r[2])) for r in rows if r[0] and r[1] and r[2]}


def contents(df: DataFrame, texts: Iterable[str], unit_ref: DataFrame, out: str = "content", density: float = DENSITY) -> DataFrame:
    """df with a struct ``out``(source, uom, qty, residual, is_unique): the content of one piece.

    ``texts`` are tried in order, the first that states a content counts; ``source`` is its position. Where its readings fit alike
    (``is_unique`` would be false), the amounts of the other texts join the identities and may decide.
    A row without any (null, empty or blank texts, or no amount in them) gets a struct of nulls. Very long
    texts are read whole. Other columns pass through; a column named ``out`` is replaced. Map-only: no shuffle.
    ``density`` is that of mass = density x volume, in grams a millilitre.
    """
    solver = F.pandas_udf(_solver(unit_factors(unit_ref), density), SCHEMA)
    return df.withColumn(out, solver(*[F.col(f"`{c}`").cast("string") for c in texts]))


def p6_contents(listings: DataFrame, sku_groups: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """(rec_table, sku_id, uom, qty, residual, is_unique): the content that each listing and sku_groups row states.

    Amounts are rounded half up to whole base units, residuals to six digits; ``is_unique`` is false where other readings fit alike. Redelivered listings count once.
    """
    a = contents(listings.select("sku_id", "sku_name_chi", "pack_size_chi"), ["sku_name_chi", "pack_size_chi"], unit_ref)
    b = contents(sku_groups.select("sku_id", "unit"), ["unit"], unit_ref)
    tidy = [
        t.filter(F.col("content.uom").isNotNull() & F.col("sku_id").isNotNull()).select(
            F.lit(name).alias("rec_table"), "sku_id", "content.uom", F.round("content.qty").cast("bigint").alias("qty"), F.round("content.residual", 6).alias("residual"), "content.is_unique"
        )
        for name, t in (("listings", a), ("sku_groups", b))
    ]
    return tidy[0].dropDuplicates(["sku_id"]).unionByName(tidy[1])


def p6_found(listings: DataFrame, sku_groups: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """(rec_table, sku_id, uom, qty): one row for each listing and sku_groups row that states a content; ``p6_contents`` tells which are not unique."""
    return p6_contents(listings, sku_groups, unit_ref).select("rec_table", "sku_id", "uom", "qty")
