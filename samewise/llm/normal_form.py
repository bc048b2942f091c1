"""Visually identical text with different characters (problem 2).

``reading_form`` brings a text to one form by which texts that a reader sees as the same are equal:

1. format characters are dropped, width, kind of space and compatibility forms folded (NFKC);
2. the text is decomposed and cut into tokens, longest runs of letters that are no ideographs;
3. of each token the *resolved script sets* of its letters are intersected: the script of a letter,
   and every script that has a letter of the same shape;
4. a token of mixed scripts, or of one script but spelled wholly with look-alikes, is re-spelled in
   the script that all its letters can take (Latin first); a token that no single script can spell
   keeps the letters that have no look-alike and spells the others in the script of the majority;
5. the result is composed again (NFC).

Shapes come from a ``LookAlikes`` table. The plain one lists the common Greek and Cyrillic look-alikes of Latin letters; ``look_alikes(spark)``
derives the whole one, for all scripts written from left to right, from the public confusables data that the session's ICU library carries.
Case, accents, spelling and traditional against simplified characters are kept, and so are digits: 0 and O differ to a reader.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.unicode_forms import CYRILLIC_AS_LATIN, CYRILLIC_LIKE, GREEK_AS_LATIN, GREEK_LIKE, fold_width

_LETTERS = "[^\\W\\d_\u1100-\u11ff\u2e80-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]"
_TOKEN = re.compile(f"{_LETTERS}(?:{_LETTERS}|[\u0300-\u036f])*")


@functools.lru_cache(maxsize=1 << 16)
def script_of(letter: str) -> str:
    """The script of a letter by its Unicode name (Latin, Greek, Cyrillic, Armenian, ...), '' for marks, which take any script."""
    if 0x300 <= ord(letter) < 0x370:
        return ""
    return unicodedata.name(letter, "").split(" ")[0].capitalize()


class LookAlikes:
    """Letters of one shape: ``shape`` of a letter, and the ``letter`` of a shape in a script."""

    def __init__(self, shape: dict[str, str]) -> None:
        self.shape = shape
        self.letter: dict[tuple[str, str], str] = {}
        self.scripts: dict[str, set[str]] = {}
        for x in sorted(shape):  # the least code point stands for its script
            self.letter.setdefault((script_of(x), shape[x]), x)
            self.scripts.setdefault(shape[x], set()).add(script_of(x))
        others = "".join(re.escape(x) for x in sorted(shape) if not x.isascii())
        self.suspect = re.compile(f"[{others}]")

    def resolved_scripts(self, letter: str) -> frozenset[str]:
        """The scripts in which a letter's shape can be spelled; empty for marks (any)."""
        own = script_of(letter)
        return frozenset(self.scripts[self.shape[letter]] | {own} if letter in self.shape else [own]) if own else frozenset()

    def spell(self, letter: str, script: str) -> str:
        """The letter of that shape in a script, the letter itself where there is none."""
        return self.letter.get((script, self.shape[letter]), letter) if letter in self.shape else letter

    def consistent(self, token: str) -> str:
        """One token of a decomposed text in the script that fits all its letters."""
        sets = [s for s in map(self.resolved_scripts, token) if s]
        if not sets:
            return token
        common = frozenset.intersection(*sets)
        if "Latin" in common:
            target = "Latin"
        elif common:
            target = min(common)
        else:  # no single script: letters without look-alikes decide, the more frequent script first
            fixed = [script_of(x) for x in token if len(self.resolved_scripts(x)) == 1] or [script_of(x) for x in token if script_of(x)]
            target = min(set(fixed), key=lambda s: (-fixed.count(s), s != "Latin", s))
        return "".join(self.spell(x, target) for x in token)


#: Common look-alikes of Latin letters.
PLAIN = LookAlikes({x: y for a, b in ((CYRILLIC_LIKE, CYRILLIC_AS_LATIN), (GREEK_LIKE, GREEK_AS_LATIN)) for x, y in zip(a, b, strict=True)} | {y: y for y in CYRILLIC_AS_LATIN + GREEK_AS_LATIN})
_WHOLE: list[LookAlikes] = []


def look_alikes(spark: SparkSession) -> LookAlikes:
    """All letters written from left to right that have a look-alike, by the skeletons of the session's ICU. Without ICU it is an error: the plain table
    finds less, so it only stands in where a caller names it (``PLAIN``).

    Letters look alike if ICU gives them one single-character skeleton and they have one case. Letters that fall apart in NFD are left to it, and
    so are letters of one script in ASCII (``l`` and ``I``). At most as many entries as Unicode has letters; made once a process.
    """
    if not _WHOLE:
        letters = [c for c in map(chr, range(0x41, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.bidirectional(c) == "L" and re.fullmatch(_LETTERS, c) and unicodedata.normalize("NFKD", c) == c]
        try:
            checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
            skeletons = checker.getSkeleton("\n".join(letters)).split("\n")
        except Exception as e:
            raise RuntimeError("the whole table of look-alikes needs a classic session with ICU (com.ibm.icu) on the driver's class path") from e
        of: dict[str, list[str]] = {}
        for c, s in zip(letters, skeletons, strict=True):
            if len(s) == 1:
                case = "u" if c.isupper() else "l"
                of.setdefault(case + s, []).append(c)
        shape = {}
        for key, cs in of.items():
            ascii_letters = [c for c in cs if c.isascii()]
            if len({script_of(c) for c in cs}) > 1 or (len(cs) > 1 and ascii_letters):
                name = ascii_letters[0] if len(ascii_letters) == 1 else key
                shape |= {c: name for c in cs if len(ascii_letters) < 2 or not c.isascii()}
        plain = {c: PLAIN.shape[c] for c in PLAIN.shape}
        _WHOLE.append(LookAlikes(shape | plain))
    return _WHOLE[0]


def reading_form(text: str | None, table: LookAlikes = PLAIN) -> str | None:
    """The one form of a text; null stays null, an empty or blank text is ''."""
    if text is None:
        return None
    folded = fold_width(text)
    if folded.isascii() or not table.suspect.search(folded):
        return folded
    loose = unicodedata.normalize("NFD", folded)
    return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: table.consistent(m[0]), loose))


def reading_form_column(column: Column | str, table: LookAlikes | None = None) -> Column:
    """The one form of a text column (an Arrow-batched function: Spark has no Unicode normalisation of its own), by the whole table of the active session unless another is given."""
    table = table or look_alikes(SparkSession.active())

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: reading_form(t, table), na_action="ignore")

    return form(F.col(column) if isinstance(column, str) else column)


def reads_same(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b): pairs of rows whose texts read the same but differ in code points, key_a < key_b.

    A key counts once with each of its distinct texts; null, empty and blank texts take part in no pair. A form that has
    one spelling only never reaches the join, so equal texts, however many, cost one count.
    Where a form has several spellings, the rows of different spellings meet in an equi-join.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("raw")).filter("key is not null and raw is not null").distinct().withColumn("form", reading_form_column("raw")).filter("form <> ''").repartition("form")
    # the exchange by form is shared by all three uses below; one spelling is told by the smallest and greatest of its forms: partial aggregates, whatever the group
    many = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("form")
    rows = rows.join(many, "form", "left_semi")
    a, b = rows.select("form", F.col("key").alias("key_a"), F.col("raw").alias("raw_a")), rows.select("form", F.col("key").alias("key_b"), F.col("raw").alias("raw_b"))
    return a.join(b, "form").filter("raw_a <> raw_b and key_a < key_b").select("key_a", "key_b").distinct()


def p2_found(listings: DataFrame, brand_ref: DataFrame) -> DataFrame:
    """(field, key_a, key_b): titles that read alike, and brands that read like one of the reference but are written otherwise."""
    titles = reads_same(listings, "sku_id", "sku_name_chi").select(F.lit("sku_name_chi").alias("field"), "key_a", "key_b")
    spelled = brand_ref.select("brand_id", F.explode(F.array("brand_canonical", "brand_alt")).alias("known")).filter("known is not null and known <> ''")
    known = spelled.select("brand_id", reading_form_column("known").alias("form")).distinct()
    entries = listings.select("sku_id", F.col("brand_name_chi").alias("raw")).filter("raw is not null and sku_id is not null").distinct()
    forms = entries.select("raw").distinct().withColumn("form", reading_form_column("raw")).filter("form <> ''")
    alike = forms.join(known, "form").join(spelled.select("brand_id", F.col("known").alias("raw")), ["brand_id", "raw"], "left_anti").select("raw", "brand_id")
    brands = entries.join(alike, "raw").select(F.lit("brand_name_chi").alias("field"), F.col("brand_id").cast("string").alias("key_a"), F.col("sku_id").alias("key_b")).distinct()
    return titles.unionByName(brands)
