"""Mapping free-entered values to a canonical list (problem 1).

1. Distinct entries are brought to their reading form and case-folded, decorations (shop words,
   company endings, marks, the list's own countries) are taken off, and the rest is cut into tokens:
   runs of Latin letters and digits, and runs of ideographs. Neighbouring tokens run together are
   tokens too, which span several places, so that lost or added blanks do no harm.
2. Each distinct token is joined to the vocabulary of the reference by edit distance: the deletion
   neighbourhoods of both sides meet in an equi-join (complete for one edit and for a
   swap of neighbours, and for two edits from ``FAR`` letters on), then the distance is computed.
3. Entries and names meet on their corrected tokens; soft TF-IDF (each place of the entry and of the name
   counts its weight times the best likeness that covers it, over both lengths) ranks the names, and the best
   wins that covers most of the entry and half of the name, or the whole name where the rest of the
   entry names nothing else. Words of no name weigh by how few entries have them.

An ideograph is only corrected where the wrong one occurs in no name of the list: two names that
differ in one ideograph of the list's own stock are different names. The same holds for a token
that is itself in the vocabulary. Two edits only correct what is rare beside the word it becomes.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.normal_form import reading_form
from samewise.session import cut, release

# What sellers put around a brand.
DECORATIONS_HAN = "官方旗艦店 官方旗舰店 旗艦店 旗舰店 專門店 专门店 專賣店 专卖店 官方店 官方 正品 品牌 授權 授权 代理"
DECORATIONS_LATIN = "official co ltd limited inc hk by brand store shop the tm r"
# Simplified characters of product names and the traditional ones (a parameter of the functions below).
SIMPLIFIED = "兰丽丝玛凯达岚伦萝诺维宝莲乐尔欧诗贝韩国台湾泽龙凤东风云长礼优净凉单发叶园妇宁层岛库开张悦无时机杨枫树桥欢气洁涛润湿灯炉烛烟热猫现画盐纱织经绿缎肤芦萤试货购轩进选钟雾静韵饼鸥鹤鹿麦径温柠纸适榄荟体阁桦鲸苇霁鹭涧网个蝉涟鲤鸢笺箫砚红峦两约绒称资规产验种为寿"
TRADITIONAL = "蘭麗絲瑪凱達嵐倫蘿諾維寶蓮樂爾歐詩貝韓國台灣澤龍鳳東風雲長禮優淨涼單發葉園婦寧層島庫開張悅無時機楊楓樹橋歡氣潔濤潤濕燈爐燭煙熱貓現畫鹽紗織經綠緞膚蘆螢試貨購軒進選鐘霧靜韻餅鷗鶴鹿麥徑溫檸紙適欖薈體閣樺鯨葦霽鷺澗網個蟬漣鯉鳶箋簫硯紅巒兩約絨稱資規產驗種為壽"

# Further pairs whose simplified character stands for several traditional ones or for itself; only used towards simplified.
MORE_TRADITIONAL = "髮製評裝隨倉價贈舊薑條臘"
MORE_SIMPLIFIED = "发制评装随仓价赠旧姜条腊"

_SIMPLIFY = dict(zip(TRADITIONAL + MORE_TRADITIONAL, SIMPLIFIED + MORE_SIMPLIFIED, strict=True))
_UNSIMPLIFY = str.maketrans(dict(zip(SIMPLIFIED, TRADITIONAL, strict=True)))
_SIMPLE = re.compile(f"[{SIMPLIFIED}]")
_TRADITIONAL = re.compile(f"[{TRADITIONAL + MORE_TRADITIONAL}]")


def traditional(text: str) -> str:
    """The text with the table's simplified characters as traditional ones; texts without any, most of them, are not rebuilt."""
    return text.translate(_UNSIMPLIFY) if _SIMPLE.search(text) else text


def one_script(text: str) -> str:
    """The text in simplified characters as far as the table goes: the direction in which no character has two counterparts."""
    return text if text.isascii() else _TRADITIONAL.sub(lambda m: _SIMPLIFY[m[0]], text)


def tokens_of(raw: str | None, places: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(script, token) of an entry in order: 'l' runs of Latin letters and digits, 'h' ideographs. Decorations are taken off, unless nothing else is left."""
    text = _plain(raw)
    out: list[tuple[str, str]] = []
    runs = [(re.sub("['’]", "", m[0]), text[m.end() : m.end() + 1] == ".") for m in _LATIN.finditer(text)]
    plain = [t for t, dotted in runs if t not in _SHOP_LATIN and not (dotted and len(t) <= 3)] or [t for t, _ in runs]
    out += [("l", t) for t in dict.fromkeys(plain)]
    for run in _HAN.findall(text):
        bare = run
        for word in sorted([*_SHOP_HAN, *places], key=lambda w: (-len(w), w)):
            if bare != word and len(bare) > len(word) + 1:
                bare = bare.removeprefix(word) if bare.startswith(word) else bare.removesuffix(word)
        if bare not in _SHOP_HAN and bare not in places:
            out.append(("h", bare))
    return list(dict.fromkeys(out))


def _plain(raw: str | None) -> str:
    text = (reading_form(_MARKS.sub(" ", raw or "")) or "").casefold()
    return traditional(unicodedata.normalize("NFC", text))


_MARKS = re.compile("[™®©℠]")  # NFKC would glue them to the name as letters
_LATIN = re.compile(r"[0-9a-z\u00df-\u00f6\u00f8-\u017f]+(?:['’][0-9a-z\u00df-\u00f6\u00f8-\u017f]+)*")
_HAN = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]+")
_SHOP_HAN = frozenset(DECORATIONS_HAN.translate(_UNSIMPLIFY).split()) | frozenset(DECORATIONS_HAN.split())
_SHOP_LATIN = frozenset(DECORATIONS_LATIN.split())
#: Letters from which a token may be two edits from its word, and how much rarer than the word it must be then.
FAR, RARER = 8, 0.1
#: Of the entry's weight and of the name's that must be met; or the whole name and this share of the entry.
COVER, NAMED, WHOLE, REST = 0.85, 0.5, 0.999, 0.3


def _spans(tokens: list[tuple[str, str]], longest: int) -> list[dict]:
    """Tokens and neighbouring ones run together, up to the vocabulary's longest word: script, token, first and last place."""
    out = []
    for script in ("l", "h"):
        own = [t for s, t in tokens if s == script]
        for i in range(len(own)):
            joined = ""
            for j in range(i, len(own)):
                joined += own[j]
                if j > i and len(joined) > longest:
                    break
                out.append({"kind": script, "token": joined, "a": i, "b": j})
    return out


SPANS = "array<struct<kind: string, token: string, a: int, b: int>>"


def _mapped(function, schema: str):
    """A vectorised column function of one text."""

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function)

    return run


def _neighbourhood(df: DataFrame, token: str, prefix: str, twice: bool) -> DataFrame:
    """df with each token's own form (at 0) and its forms with one character deleted (two where ``twice``): columns form and ``prefix``_at."""
    size = F.length(token)
    without = lambda t, i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))
    one = F.when(size >= 3, F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(without(F.col(token), i).alias("form"), i.alias("at")))).otherwise(F.array().cast("array<struct<form: string, at: int>>"))
    own = F.array(F.struct(F.col(token).alias("form"), F.lit(0).alias("at")))
    forms = F.concat(own, one)
    if twice:
        pairs = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(i, size - 1), lambda j: F.struct(without(without(F.col(token), i), j).alias("form"), F.lit(-1).alias("at")))))
        forms = F.array_distinct(F.when(size >= FAR, F.concat(forms, pairs)).otherwise(forms))
    return df.withColumn("d", F.explode(forms)).select("*", F.col("d.form").alias("form"), F.col("d.at").alias(f"{prefix}_at")).drop("d")


def correct_tokens(tokens: DataFrame, vocabulary: DataFrame, stock: DataFrame | None = None, least: int = 4) -> DataFrame:
    """(kind, token, word, sim): each distinct token with the vocabulary's words at most one edit (or swap) away, two between words of FAR letters and more.

    tokens and vocabulary have the columns kind and token / word; tokens may have n, the rows they stand in. A token of the vocabulary is itself only.
    Latin tokens shorter than ``least`` are never corrected; ideographs of three and more are, where the wrong one is not in ``stock`` (kind, c).
    Two edits away, a token of several rows must have at most RARER of the rows in which the word itself stands. Words that no length allows to meet are not paired.
    """
    t = tokens.groupBy("kind", "token").agg((F.sum("n") if "n" in tokens.columns else F.lit(1)).alias("n"))
    v = vocabulary.select("kind", "word").distinct()
    own = t.select("kind", F.col("token").alias("word"), F.col("n").alias("word_n"))
    same = t.join(v.withColumn("token", F.col("word")), ["kind", "token"]).select("kind", "token", "word", F.lit(1.0).alias("sim"))
    longest = v.agg(F.max(F.length("word")).alias("longest"))  # a token longer by over two edits than all words meets none
    rest = t.join(v.withColumn("token", F.col("word")), ["kind", "token"], "left_anti").filter(F.length("token") >= F.when(F.col("kind") == "h", 2).otherwise(least)).crossJoin(F.broadcast(longest)).filter(F.length("token") <= F.col("longest") + 2).drop("longest")
    words = v.join(own, ["kind", "word"], "left").filter(F.length("word") >= F.when(F.col("kind") == "h", 3).otherwise(least))
    a, b = _neighbourhood(rest, "token", "t", True), _neighbourhood(words, "word", "w", True)
    swapped = (F.length("token") == F.length("word")) & (F.abs(F.col("t_at") - F.col("w_at")) == 1) & (F.substring("token", F.col("t_at"), F.lit(1)) == F.substring("word", F.col("w_at"), F.lit(1))) & (F.col("t_at") > 0) & (F.col("w_at") > 0)
    far = (F.col("kind") != "h") & (F.length("token") >= FAR) & (F.length("word") >= FAR) & ((F.col("n") <= 1) | (F.col("n") <= RARER * F.coalesce("word_n", F.lit(0))))
    distance = F.levenshtein("token", "word")
    near = a.join(b, ["kind", "form"]).withColumn("d", F.when((F.col("kind") != "h") & swapped, 1).otherwise(distance)).filter((F.col("d") <= 1) | ((F.col("d") == 2) & far))
    if stock is not None:
        # ideographs: only a substitution, by one that no name of the list has
        replaced = (F.col("t_at") > 0) & (F.col("t_at") == F.col("w_at")) & (F.length("token") == F.length("word"))
        wrong = F.when((F.col("kind") == "h") & replaced, F.substring("token", F.col("t_at"), F.lit(1)))
        near = cut(near.groupBy("kind", "token", "word", wrong.alias("c")).agg(F.min("d").alias("d")))  # else both scripts' plans hold the whole join
        han = near.filter("c is not null").join(stock, "c", "left_anti").select(near.columns)
        near = near.filter("kind <> 'h'").unionByName(han)
    near = near.groupBy("kind", "token", "word").agg(F.min("d").alias("d")).select("kind", "token", "word", (1 - 0.5 * F.col("d") / F.length("word")).alias("sim"))
    return same.unionByName(near)


def _covered(places: str, met: str, first: str, last: str) -> Column:
    """Each place's weight with the best likeness of a met token that covers it."""
    best = lambda k: F.coalesce(F.array_max(F.transform(F.filter(met, lambda m: (m[first] <= k) & (m[last] >= k)), lambda m: m["sim"])), F.lit(0.0))
    return F.transform(places, lambda w, k: F.struct((w * w).alias("w"), best(k).alias("sim")))


def _sum(column: str, value) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda s, x: s + value(x))


def resolve(entries: DataFrame, raw: str, brand_ref: DataFrame, cover: float = COVER, named: float = NAMED) -> DataFrame:
    """(raw, brand_id, score): the name of the list that each distinct entry names, 0 where it names none.

    Both scripts of a name stand for it. Of the weights at least ``cover`` of the entry's and ``named`` of the name's must be met, or the WHOLE name
    and REST of the entry; among such names the best soft TF-IDF wins, ties go to the smaller id. Repeated rows of ``entries`` tell how common its
    tokens are. Null entries have no row; empty and blank ones name none. The list may have any number of names and countries: they are only joined.
    """
    names = brand_ref.select("brand_id", F.explode(F.array("brand_canonical", "brand_alt")).alias("name")).filter("name is not null")
    bare = _mapped(lambda x: _spans(tokens_of(x), 1 << 30), SPANS)
    name_spans = names.withColumn("t", F.explode(bare("name"))).select("brand_id", "name", "t.*").withColumnRenamed("token", "word").distinct()
    n_names = names.agg(F.count("*").alias("n_names"))
    idf = name_spans.groupBy("kind", "word").agg(F.countDistinct("brand_id").alias("df")).crossJoin(F.broadcast(n_names)).select("kind", "word", F.log(F.col("n_names") / F.col("df") + 1).alias("w"), F.log(F.col("n_names") + 1.0).alias("w_most"))
    # written between the steps: one plan of all of them, replanned at each of its stages, is what fills a driver
    name_spans = cut(name_spans.join(idf, ["kind", "word"]))
    facts = name_spans.agg(F.max(F.length("word")), F.max("w_most")).first()
    longest, w_most = facts[0] or 0, facts[1] or 1.0
    name_size = name_spans.filter("a = b").groupBy("brand_id", "name", "kind").agg(F.array_sort(F.collect_list(F.struct("a", "w"))).alias("x")).select("brand_id", "name", "kind", F.transform("x", lambda p: p["w"]).alias("name_w"))
    stock = name_spans.filter("kind = 'h'").select(F.explode(F.split("word", "")).alias("c")).distinct()

    e = entries.select(F.col(f"`{raw}`").alias("raw")).filter("raw is not null").groupBy("raw").agg(F.count("*").alias("n"))
    if "home_country" in brand_ref.columns:
        countries = brand_ref.select(F.col("home_country").alias("place")).filter("home_country is not null").distinct()
        place = _mapped(traditional, "string")
        countries = cut(countries.select(place("place").alias("place")).distinct())
        widest = countries.agg(F.max(F.length("place"))).first()[0] or 0

        def stretches(text: str) -> list[str]:
            return list(dict.fromkeys(r[i : i + n] for r in _HAN.findall(_plain(text)) for n in range(1, widest + 1) for i in range(len(r) - n + 1)))

        parts = _mapped(stretches, "array<string>")
        seen = e.select("raw", F.explode(parts("raw")).alias("place")).join(countries, "place").groupBy("raw").agg(F.collect_set("place").alias("places"))
        e = e.join(seen, "raw", "left")
    else:
        e = e.withColumn("places", F.lit(None).cast("array<string>"))

    @F.pandas_udf(SPANS)
    def cut_up(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([_spans(tokens_of(t, frozenset(p) if p is not None else frozenset()), longest + 2) for t, p in zip(texts, places, strict=True)])

    entry_spans = cut(e.withColumn("t", F.explode(cut_up("raw", "places"))).select("raw", "n", "t.*"))
    fixed = cut(correct_tokens(entry_spans, name_spans, stock))
    release(entries.sparkSession)
    total = entry_spans.agg(F.countDistinct("raw")).first()[0] or 1
    common = entry_spans.filter("a = b").groupBy("kind", "token").agg(F.countDistinct("raw").alias("df"))
    known = fixed.join(idf.select("kind", "word", "w"), ["kind", "word"]).groupBy("kind", "token").agg(F.max("w").alias("w"))
    unknown = F.lit(w_most) * F.log(total / F.col("df") + 1) / F.log(F.lit(total + 1.0))
    place_w = entry_spans.filter("a = b").join(common, ["kind", "token"]).join(known, ["kind", "token"], "left").select("raw", "kind", "a", F.coalesce("w", unknown).alias("w"))
    entry_size = place_w.groupBy("raw", "kind").agg(F.array_sort(F.collect_list(F.struct("a", "w"))).alias("x")).select("raw", "kind", F.transform("x", lambda p: p["w"]).alias("entry_w"))
    met = entry_spans.join(fixed, ["kind", "token"]).join(name_spans.select("kind", "word", "brand_id", "name", F.col("a").alias("na"), F.col("b").alias("nb")), ["kind", "word"])
    met = met.groupBy("raw", "kind", "brand_id", "name").agg(F.collect_set(F.struct("a", "b", "na", "nb", "sim")).alias("met")).join(entry_size, ["raw", "kind"]).join(name_size, ["brand_id", "name", "kind"])
    met = met.select("raw", "brand_id", _covered("entry_w", "met", "a", "b").alias("e"), _covered("name_w", "met", "na", "nb").alias("m"))
    share = lambda side: _sum(side, lambda x: F.when(x["sim"] > 0, x["w"]).otherwise(0.0)) / _sum(side, lambda x: x["w"])
    likeness = lambda side: _sum(side, lambda x: x["w"] * x["sim"]) / _sum(side, lambda x: x["w"])
    scored = met.select("raw", "brand_id", F.sqrt(likeness("e") * likeness("m")).alias("score"), share("e").alias("of_entry"), share("m").alias("of_name"))
    scored = scored.filter(((F.col("of_entry") >= cover) & (F.col("of_name") >= named)) | ((F.col("of_name") >= WHOLE) & (F.col("of_entry") >= REST)))
    best = cut(scored.groupBy("raw").agg(F.max_by("brand_id", F.struct("score", -F.col("brand_id"))).alias("brand_id"), F.max("score").alias("score")))
    return e.select("raw").join(best, "raw", "left").select("raw", F.coalesce("brand_id", F.lit(0)).cast("bigint").alias("brand_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def p1_found(listings: DataFrame, sku_groups: DataFrame, brand_ref: DataFrame) -> DataFrame:
    """(rec_table, sku_id, brand_id): the brand that each filled entry names which is not exactly a brand_canonical; 0 for none."""
    exact = brand_ref.select(F.col("brand_canonical").alias("raw")).filter("raw is not null").distinct()

    def filled(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.select(F.lit(name).alias("rec_table"), "sku_id", F.col(column).alias("raw")).filter("sku_id is not null and raw is not null and raw <> ''").distinct()

    rows = filled(listings, "listings", "brand_name_chi").unionByName(filled(sku_groups, "sku_groups", "brand_canonical"))
    found = resolve(rows, "raw", brand_ref).join(exact, "raw", "left_anti")
    return rows.join(found, "raw").select("rec_table", "sku_id", "brand_id")
