"""Text functions as Spark columns. Null texts count as '' unless a function says otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from samewise.config import DEFAULT_PACK, DomainPack

_SIGN = re.compile(r"[^\x00-\x7f\w\s]")


def plain_sign(c: str) -> str:
    """A sign that NFKC leaves apart as its plain counterpart, told by its Unicode category: brackets are square, dashes short, symbols blanks."""
    kind = unicodedata.category(c)
    return {"Ps": "[", "Pe": "]", "Pd": "-", "So": " "}.get(kind, c)


FOLD_DROPS = r"[^\p{L}\p{N}_%]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row. A bare expression used inside a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nfkc_text(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "")
    return " ".join((folded if folded.isascii() else _SIGN.sub(lambda m: plain_sign(m[0]), folded)).split())


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(nfkc_text)


def nfkc(c: Column | str) -> Column:
    """NFKC, signs folded, blanks collapsed and trimmed; case kept; null gives ''. (Spark has no normalisation of its own.)"""
    return _nfkc(col(c))


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def _without(c: Column | str, pattern: str) -> Column:
    return squeeze(F.regexp_replace(col(c), f"(?i)(?:{pattern})", " "))


def strip_noise(c: Column | str, pack: DomainPack = DEFAULT_PACK) -> Column:
    return _without(c, pack.noise)


def strip_gift(c: Column | str, pack: DomainPack = DEFAULT_PACK) -> Column:
    return _without(c, pack.gift)


def clean_title(c: Column | str, pack: DomainPack = DEFAULT_PACK) -> Column:
    """Of an NFKC text: gifts, then noise, then brackets left empty are taken off. Numbers and units stay."""
    return squeeze(F.regexp_replace(strip_noise(strip_gift(c, pack), pack), r"[\[(【（]\s*[\])】）]", " "))


def fold(c: Column | str) -> Column:
    """Comparison key: letters, digits, _ and % in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), FOLD_DROPS, "")


def ngrams(c: Column | str, n: int) -> Column:
    """All character n-grams in order, with repeats; [] for shorter texts."""
    return let(col(c), lambda s: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def _grams_of(n: int):
    return lambda s: ngrams(s, n)  # a second parameter of the lambda would be taken for the position


def _prefixed(prefix: str):
    return lambda g: F.concat(F.lit(prefix), g)


def char_ngrams(c: Column | str, n: int = 2) -> Column:
    """The set of n-grams of the folded text, sorted."""
    return F.array_sort(F.array_distinct(ngrams(fold(c), n)))


def tail_text(c: Column | str, n: int = 12) -> Column:
    """The last n characters of what follows the last dash, pipe or colon."""
    return F.right(F.trim(F.element_at(F.split(F.coalesce(col(c), F.lit("")), r"[-–—|｜:：]"), -1)), F.lit(n))


def lcp_ratio(a: Column | str, b: Column | str) -> Column:
    """Length of the common prefix of the folded texts over the longer one's; 0 where either is empty."""
    def ratio(p: Column) -> Column:
        x, y = p["x"], p["y"]
        shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
        # the last position up to which all characters agree
        same = F.aggregate(F.sequence(F.lit(1), shorter), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))), i).otherwise(n))
        return F.when(shorter > 0, same / longer).otherwise(0.0)

    return let(F.struct(fold(a).alias("x"), fold(b).alias("y")), ratio)


def display_width(c: Column | str) -> Column:
    """Columns on a fixed grid: wide and full-width characters take two."""
    c = F.coalesce(col(c), F.lit(""))
    return F.length(c) + F.length(F.regexp_replace(c, "[^ᄀ-ᅟ⺀-〾ぁ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]", ""))


def plain_number(c: Column | str) -> Column:
    """A number as people write it: no exponent, no trailing zeros (100, 2.5)."""
    c = col(c).cast("decimal(30,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def unit_pattern(pack: DomainPack = DEFAULT_PACK) -> str:
    return "|".join(re.escape(u) for u in sorted(pack.units, key=lambda u: (-len(u), u)))


PACK_WORDS = r"\d+\s*[x×*]\s*\d+|[x×*]\s*\d+|[一二兩三四五六七八九十單\d]+\s*(?:件|塊|個|入|枚|條|支|包|盒)\s*裝?|pack of\s*\d+|\d+-pack|原箱|套裝"


def form_pattern(pack: DomainPack = DEFAULT_PACK) -> str:
    return "|".join(p for _, p in pack.forms)


def packfree(c: Column | str, pack: DomainPack = DEFAULT_PACK) -> Column:
    """A clean title without sizes and pack counts; kinds and variants stay."""
    no_units = F.regexp_replace(clean_title(c, pack), rf"(?i)\d+(?:\.\d+)?\s*(?:{unit_pattern(pack)})", " ")
    return squeeze(F.regexp_replace(no_units, f"(?i)(?:{PACK_WORDS})", " "))


def known_words(pack: DomainPack = DEFAULT_PACK) -> str:
    """Pattern of the words of a title that are no variant: kinds and generic words."""
    return f"(?i)(?:{form_pattern(pack)}|{pack.generic})"


def residual(c: Column | str, brand: Column | str, pack: DomainPack = DEFAULT_PACK) -> Column:
    """The variant: what a title says beyond brand, size, pack count, kind and generic words.

    One pattern made of the row's own brand words (of two and more characters, the longest first), then one of the known words.
    """
    words = F.filter(F.split(F.lower(F.coalesce(col(brand), F.lit(""))), r"[^\p{L}\p{N}&.']+"), lambda w: F.length(w) > 1)
    ordered = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w")))), lambda x: F.concat(F.lit("\\Q"), x["w"], F.lit("\\E")))
    own = F.when(F.size(words) > 0, F.concat_ws("|", ordered)).otherwise(F.lit("(?!)"))
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(packfree(c, pack)), own, F.lit(" ")), known_words(pack), " "))


def tokens(c: Column | str, brand: Column | str, lo: int = 2, hi: int = 4, pack: DomainPack = DEFAULT_PACK) -> Column:
    """Of the residual: Latin words of three and more letters and all lo- to hi-grams of runs of ideographs, sorted and distinct."""
    bad = known_words(pack)

    def cut_up(r: Column) -> Column:
        runs = F.regexp_extract_all(r, F.lit(r"([\x{4e00}-\x{9fff}]+)"), F.lit(1))
        grams = [F.flatten(F.transform(runs, _grams_of(n))) for n in range(lo, hi + 1)]
        return F.concat(F.regexp_extract_all(r, F.lit("([a-z]{3,})"), F.lit(1)), *grams)

    return F.array_sort(F.array_distinct(F.filter(let(residual(c, brand, pack), cut_up), lambda t: ~t.rlike(bad))))


def hashed_terms(c: Column | str) -> Column:
    """Terms for hashed vectors, with repeats: Latin words as w:, 2- to 4-grams of the folded text as c2: to c4:."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.concat(F.lit("w:"), w))
    return F.concat(words, let(fold(c), lambda f: F.concat(*[F.transform(ngrams(f, n), _prefixed(f"c{n}:")) for n in (2, 3, 4)])))


def labelled_text(*parts: tuple[str, Column | str]) -> Column:
    """'label: text' lines of the parts that are filled, for text services."""
    return F.concat_ws("\n", *[F.when(F.length(F.trim(col(c))) > 0, F.concat(F.lit(f"{label}: "), F.trim(col(c)))) for label, c in parts])


# -- naming helpers, plain Python: they run per group inside pandas functions


def intervals(terms, text: str) -> list[tuple[int, int]]:
    """Stretches of a text that its terms cover, overlapping occurrences as one, in their order."""
    spans = sorted((m.start(), m.start() + len(t)) for t in set(terms) if t for m in re.finditer(f"(?={re.escape(t)})", text))
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def phrases(terms, texts) -> list[str]:
    """What the terms, windows of phrases, cover in the attested texts: each different stretch that is part of no other, the longest first.

    Terms that no text has stand for themselves; without texts every term does.
    """
    terms = set(terms)
    found = {text[a:b] for text in texts for a, b in intervals(terms, text)}
    found |= {t for t in terms if not any(t in f for f in found)}
    return [f for f in sorted(found, key=lambda f: (-len(f), f)) if not any(f != g and f in g for g in found)]


def variant_label(terms, texts=(), prefer=(), limit: int = 3, exclude=()) -> str:
    """At most ``limit`` phrases for a name. Preferred ones come first, what the name prints elsewhere last and only where nothing else is there."""
    printed = [x for x in exclude if x and len(x) > 1]
    ranked = sorted(phrases(terms, texts), key=lambda f: (any(f in x for x in printed), f not in prefer))
    new = [f for f in ranked if not any(f in x for x in printed)]
    return "·".join((new or ranked)[:limit])
