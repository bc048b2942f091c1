"""Product listings describing the same item (problem 5), by title combination voting over tokens learned from the corpus.

1. *Tokens.* Titles and descriptions are brought to one form (reading form, small letters, one script of Chinese). Brand names and countries of the
   reference and amounts are taken off; what is left of a title is cut into Latin words and runs of ideographs. Long runs are segmented by the corpus itself:
   a run is one unit unless commoner units make it up (``手工皂紙`` is ``手工`` + ``皂紙``), and an ending that follows a fiftieth of all
   different runs (``系列``) is an affix. Neighbouring Latin words that seek each other are one token.
2. *Attributes.* A title's frequent token says something about the product if the descriptions beside it differ from all descriptions; advertising
   does not. Tokens that predict the same descriptions are one class (``桂花``, ``木犀花``, ``osmanthus``), and classes that exclude each other in
   titles are the values of one attribute (kinds, scents). No word list is used.
3. *Names.* Rare tokens that descriptions repeat or that carry an affix are product lines, of whatever length; tokens that stand beside many lines name
   families of them (brands outside the list). A name that nearly always stands with one line is that line in another script.
4. *Brand.* From the title, else from the brand field by problem 1's operator, else a family. It is part of every product; unknown brands match any.
5. *Voting.* Listings with all tokens are products. k-combinations of tokens are scored by how often, with how many tokens and how early in the titles
   they stand; each title that lacks tokens takes its best combination that holds one product only (verification). Titles left over
   vote among themselves, so products of which no listing is complete have groups too.

An amount printed in base units is kept as it is. One printed in another unit or a fraction is the exact amount nearest to it among its line's, within
the error of its printed digits, or within ``SPREAD`` for pounds and ounces.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from itertools import combinations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions.unicode_forms import fold_letters, plain_letters
from samewise.llm.brands import one_script, resolve
from samewise.llm.normal_form import reading_form
from samewise.operators.quantities import IMPERIAL, UNIT_WORDS, _READING, printed_error, readings, solve, unit_factors
from samewise.session import cut as cut_lineage
from samewise.session import forget, release

#: Log distance within which an amount in pounds or ounces stands for an exact one (half a pound for 250 g).
SPREAD = 0.105
#: Share of all listings, and least number of them, from which a token is frequent. At most tokens-a-title / FREQUENT tokens are, whatever the corpus.
FREQUENT, LEAST = 0.001, 20
#: Listings from which a unit or phrase is trusted.
SUPPORT = 3
#: Ideographs of the longest unit, and of the longest line that only a description has.
UNIT, LINE = 12, 6
#: Share of all different runs that an affix must end, and of a name's occurrences that must go with one line.
AFFIX, ALIAS = 0.02, 0.8
#: Deviation (in standard errors) and effect (log ratio) from which a title's token and a description's belong together.
DEVIATION, EFFECT = 6.0, 0.4
#: Average likeness of the tokens of one class; occurrence together, against chance, of classes of one attribute; share of listings an attribute reaches.
LIKENESS, EXCLUSIVE, REACH = 0.5, 0.25, 0.05
#: Descriptions that would have repeated a name; fewer tell nothing against it.
UNTOLD = 8
#: Bound of the reference of brands, which each task reads titles with.
BRANDS = 50_000

_HAN, _LATIN = "㐀-䶿一-鿿", "a-zß-öø-ÿĀ-ſ"
_PIECE = re.compile(rf"[{_HAN}]+|(?<![0-9{_LATIN}-])[{_LATIN}]{{2,}}(?: [{_LATIN}]{{2,}})*(?![0-9{_LATIN}])")
_RUN = re.compile(f"[{_HAN}]+")
_CODE = re.compile(rf"(?<![a-z0-9])(?=[a-z0-9-]*[a-z])(?=(?:[a-z0-9-]*\d){{3}})[a-z0-9]{{5,}}(?:-\d+)?(?![a-z0-9])")
_UNITS = frozenset(w for words in UNIT_WORDS.values() for w in words.split()) | {"fl"}


def cut(df: DataFrame) -> DataFrame:
    """A table read once or twice: columns of mostly different texts, for which dictionaries cost time and no block is much smaller."""
    return cut_lineage(df, **{"parquet.enable.dictionary": "false", "compression": "lz4_raw"})


def folded(text: str | None) -> str:
    return one_script((reading_form(text) or "").casefold())


def automaton(words: dict[str, int]):
    a = ahocorasick.Automaton()
    for w, value in words.items():
        a.add_word(w, (value, len(w)))
    a.make_automaton()
    return a


def _letter(c: str) -> bool:
    return c < "㐀" and c.isalnum()


def scan(a, text: str) -> list[tuple[int, int, int]]:
    """(start, end, value) of the automaton's words in a text, leftmost and longest first, Latin ones as whole words."""
    if not len(a) or not text or not (hits := [(e - n + 1, -n, v) for e, (v, n) in a.iter(text)]):
        return []
    hits.sort()
    out, last = [], -1
    for s, n, v in hits:
        e = s - n
        if s < last or (s and _letter(text[s]) and _letter(text[s - 1])) or (e < len(text) and _letter(text[e - 1]) and _letter(text[e])):
            continue
        out.append((s, e, v))
        last = e
    return out


def blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for s, e, _ in spans:
        parts += [text[at:s], " / "]
        at = e
    return "".join([*parts, text[at:]])


# -- 1. tokens


# lists of tokens go between steps as strings joined by "/", which no piece holds: far cheaper to write, sort and hand to Python than arrays

READ = "pieces string, words string, shown array<bigint>, uom string, qty double, error double, imperial boolean, code string, about string"


def _content(text: str | None, factors) -> tuple | None:
    if text and (got := solve(found := readings(text), factors)):
        imperial = not any(r["code"] not in IMPERIAL and abs(math.log(v * factors[r["code"]][1] / got[1])) < 1e-6 for r in found if r["code"] in factors for v in r["numbers"])
        return got[0], got[1], printed_error(found, factors, got[1]), imperial
    return None


def _letters(text: str) -> str:
    """fold_letters of a folded text."""
    return text if plain_letters(text) else fold_letters(text)


def _pieces(text: str, hits: list[tuple[int, int, int]]) -> list[str]:
    return _PIECE.findall(_READING.sub(" / ", blank(text, hits)))


def _reader(names: dict[str, int], factors):
    """Titles to pieces, their different Latin words and pairs of neighbouring ones, the listed brands they show, content, item code, and the description without names and amounts. What is repeated in a batch is read once."""

    @F.pandas_udf(READ)
    def read(title: pd.Series, pack: pd.Series, description: pd.Series) -> pd.DataFrame:
        known, out = automaton(names), []

        @functools.cache
        def content(text: str | None) -> tuple | None:
            return _content(fold_letters(text), factors)

        @functools.cache
        def told(text: str | None) -> tuple[str, str]:
            d = folded(text)
            return d, _READING.sub(" / ", blank(d, scan(known, d)))

        for t, p, d in zip(title, pack, description, strict=True):
            t, (d, about) = folded(t), told(d)
            hits = scan(known, t)
            code = m[0].replace("-", "") if (m := _CODE.search(_READING.sub(" ", t))) else None
            got = _content(_letters(t), factors) or content(p) or content(d) or (None, None, None, None)
            pieces, words = _pieces(t, hits), {}
            for p in pieces:
                if p[0] < "㐀":
                    ws = p.split()
                    words |= dict.fromkeys([*ws, *map(" ".join, zip(ws, ws[1:], strict=False))])
            out.append(("/".join(pieces), "/".join(words), sorted({v for *_, v in hits if v >= 0}), *got, code, about))
        return pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")])

    return read


def brand_names(brand_ref: DataFrame) -> dict[str, int]:
    """Names of the list with their brand, and its countries with -1. More than BRANDS rows are refused."""
    ref = brand_ref.select("brand_id", "brand_canonical", "brand_alt", "home_country").limit(BRANDS + 1).collect()
    if len(ref) > BRANDS:
        raise ValueError(f"the reference of brands has over {BRANDS} rows")
    names = {folded(r.home_country): -1 for r in ref if r.home_country} | {folded(x): r.brand_id for r in ref for x in (r.brand_canonical, r.brand_alt) if x}
    names.pop("", None)
    return names


def each(joined: str, name: str) -> Column:
    """A row for each part of a joined string; an empty one has the part ''."""
    return F.explode(F.split(joined, "/")).alias(name)


def read_listings(listings: DataFrame, names: dict[str, int], unit_ref: DataFrame) -> DataFrame:
    """One row for each sku_id, and a number of its own, id; listings without sku_id take no part, redelivered ones count once. The widest exchange; what follows goes by id."""
    read = _reader(names, unit_factors(unit_ref))
    rows = listings.filter("sku_id is not null").select("sku_id", F.col("brand_name_chi").alias("entry"), read("sku_name_chi", "pack_size_chi", "description_chi").alias("t"))
    rows = rows.groupBy("sku_id").agg(F.min(F.struct("t", "entry")).alias("x")).select(F.monotonically_increasing_id().alias("id"), "sku_id", "x.entry", "x.t.*")
    article = F.regexp_extract("sku_id", r"_S_([0-9]{13})(?![0-9])", 1)
    return cut(rows.withColumn("article", F.when(article != "", article)))


def each_run(rows: DataFrame) -> DataFrame:
    """(id, run): the different runs of ideographs of each title."""
    return rows.select("id", F.explode(F.array_distinct(F.split("pieces", "/"))).alias("run")).filter(F.col("run") >= "㐀")


def segment(run: str, counts: dict[str, int], affixes: dict[str, int], total: int) -> list[str]:
    """A run of ideographs as the likeliest sequence of units. counts: how many listings have each part of the run as a run of its own.

    A unit of four and more ideographs that commoner units make up, or that ends in an affix, is none; an unknown stretch is one unit.
    """
    known = {w: n for w, n in counts.items() if n >= SUPPORT or w in affixes}

    def best(x: str, whole: bool) -> list[str]:
        score, back = [0.0] + [-math.inf] * len(x), [0] * (len(x) + 1)
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1 if i == 0 and len(x) > UNIT else min(len(x), i + UNIT) + 1):
                w = x[i:j]
                if w == x and not whole:
                    continue
                s = score[i] + (math.log(known[w] / total) if w in known else -20 - 2 * (j - i))
                if s > score[j]:
                    score[j], back[j] = s, i
        out, j = [], len(x)
        while j:
            out.append(x[back[j] : j])
            j = back[j]
        return out[::-1]

    for w in sorted(known, key=lambda w: (len(w), w)):
        if len(w) >= 4 and w not in affixes:
            parts = best(w, False)
            if all(p in known and known[p] >= known[w] for p in parts) or any(w.endswith(a) and len(w) > len(a) + 1 for a in affixes):
                del known[w]
    return best(run, True)


def segmented(runs: DataFrame, affixes: dict[str, int], total: int) -> DataFrame:
    """(run, units) of the runs of four and more ideographs; shorter ones are units. ``runs`` has run and n."""

    @F.pandas_udf("array<string>")
    def cut_up(run: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for r, ps in zip(run, parts, strict=True):
            counts = {p["part"]: p["n"] for p in ps}
            out.append(segment(r, counts | {a: counts.get(a, 0) + n for a, n in affixes.items() if a in r}, affixes, total))
        return pd.Series(out)

    long = runs.filter(F.length("run") >= 4)
    sizes = F.sequence(F.lit(2), F.least(F.length("run"), F.lit(UNIT)))
    # a lambda's parameter is used for the inner one's bounds, so both are spelled out
    spans = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substring("run", i, k))))
    parts = long.select("run", F.explode(F.array_distinct(spans)).alias("part"))
    counts = runs.filter((F.length("run") <= UNIT) & (F.col("n") >= SUPPORT)).select(F.col("run").alias("part"), "n")
    # Spark takes exploded rows for as small as those they come from, so without a hint it sends all parts of up to the broadcast limit's runs through the driver
    met = parts.join(counts.hint("merge"), "part").groupBy("run").agg(F.collect_list(F.struct("part", "n")).alias("parts"))
    empty = F.array().cast("array<struct<part: string, n: bigint>>")
    return long.join(met, "run", "left").select("run", "n", cut_up("run", F.coalesce("parts", empty)).alias("units"))


def lexicon(rows: DataFrame, total: int) -> tuple[DataFrame, dict[str, int], frozenset[str]]:
    """(runs with units, affixes, phrases). Affixes and phrases are bounded: a run has three endings, a title so many pairs of words."""
    runs = each_run(rows).groupBy("run").agg(F.count("*").alias("n"))
    runs = cut(runs)
    kinds = runs.count()
    ends = runs.filter(F.length("run") >= 3).select("run", F.explode(F.array(*[F.when(F.length("run") >= k + 2, F.struct(F.right("run", F.lit(k)).alias("end"), F.expr(f"left(run, length(run) - {k})").alias("stem"))) for k in (1, 2, 3, 4)])).alias("x")).select("x.end", "x.stem")
    stems = ends.filter("end is not null").join(runs.select(F.col("run").alias("stem")), "stem")
    found = stems.groupBy("end").agg(F.count("*").alias("n")).filter(F.col("n") >= max(LEAST, AFFIX * kinds)).collect()
    affixes = {r.end: r.n for r in found}
    words = rows.select(each("words", "w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    words = cut(words.filter(F.col("n") >= SUPPORT))
    pairs = words.filter(F.contains("w", F.lit(" ")) & (F.col("n") >= max(5, FREQUENT * total / 4))).select("w", "n", F.element_at(F.split("w", " "), 1).alias("a"), F.element_at(F.split("w", " "), 2).alias("b"))
    single = words.filter(~F.contains("w", F.lit(" ")))
    pairs = pairs.join(single.select(F.col("w").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("w").alias("b"), F.col("n").alias("nb")), "b")
    sought = F.log(F.col("n") * total / F.col("na") / F.col("nb")) / -F.log(F.col("n") / total)
    phrases = frozenset(r.w for r in pairs.filter((F.col("n") < total) & (sought >= 0.4)).select("w").collect())
    units = cut(segmented(runs, affixes, total))
    forget(words, runs)
    return units, affixes, phrases


def tokens(rows: DataFrame, units: DataFrame, affixes: dict[str, int], phrases: frozenset[str], total: int) -> DataFrame:
    """(id, ws, ats, about): the distinct tokens of each title, their positions among the pieces, with + where an affix followed, and the description.

    Units of frequent runs, a bounded number, go to the tasks as they are; only rare long runs of several units meet them in a join, so no key is hot.
    """
    often = FREQUENT * total
    common = {r.run: r.units for r in units.filter(F.col("n") >= often).select("run", "units").collect()}
    rare = units.filter((F.col("n") < often) & (F.size("units") > 1)).select("run", F.concat("run", F.lit("="), F.array_join("units", "/")).alias("parts"))
    met = each_run(rows).filter(F.length("run") >= 4).join(rare, "run").groupBy("id").agg(F.array_join(F.collect_list("parts"), ";").alias("found"))

    @F.pandas_udf("ws string, ats string")
    def cut_up(pieces: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for ps, own in zip(pieces, found, strict=True):
            units_of = {r: x.split("/") for r, x in (y.split("=") for y in own.split(";"))} if own else {}
            got: dict[str, list] = {}
            for at, p in enumerate(ps.split("/") if ps else ()):
                if p[0] >= "㐀":
                    ws = units_of.get(p) or common.get(p) or [p]
                else:
                    ws, parts, i = [], p.split(), 0
                    while i < len(parts):
                        both = " ".join(parts[i : i + 2])
                        k = 2 if both in phrases and i + 1 < len(parts) else 1
                        ws.append(" ".join(parts[i : i + k]))
                        i += k
                for k, w in enumerate(ws):
                    if len(w) > 1 and w not in affixes and w not in _UNITS:
                        x = got.setdefault(w, [at, False])
                        x[1] = x[1] or (k + 1 < len(ws) and ws[k + 1] in affixes)
            out.append(("/".join(got), "/".join(f"{at}+" if marked else str(at) for at, marked in got.values())))
        return pd.DataFrame(out, columns=["ws", "ats"])

    return rows.select("id", "pieces", "about").join(met, "id", "left").select("id", cut_up("pieces", "found").alias("t"), "about").select("id", "t.*", "about")


# -- 2. attributes


def _met(frequent: dict[str, int]):
    """Partial counts of (kind, a, b, n): 'd' title's token a beside the description's b, 't' two tokens of one title; -1 stands for all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, size = automaton(frequent), len(frequent) + 1
        sums: dict[str, dict[int, int]] = {"d": {}, "t": {}}
        for b in batches:
            keys = {"d": [], "t": []}
            told_of: dict[str, list[int]] = {}
            for ws, about in zip(b["ws"], b["about"], strict=True):
                own = [frequent[w] for w in ws.split("/") if w in frequent]
                keys["t"] += [x * size + y for x in own for y in own]
                if about:
                    if (told := told_of.get(about)) is None:
                        told = told_of[about] = [*{v for *_, v in scan(known, about)}, size - 1]
                    keys["d"] += [x * size + y for x in [*own, size - 1] for y in told]
            for kind, ks in keys.items():
                for k, n in zip(*np.unique(np.array(ks, np.int64), return_counts=True), strict=True):
                    sums[kind][int(k)] = sums[kind].get(int(k), 0) + int(n)
        rows = [(kind, k // size, k % size, n) for kind, s in sums.items() for k, n in s.items()]
        yield pd.DataFrame([(kind, -1 if a == size - 1 else a, -1 if b == size - 1 else b, n) for kind, a, b, n in rows], columns=["kind", "a", "b", "n"])

    return run


def classes_of(words: list[str], deviations: list[tuple[int, int, float]], dims: int) -> list[list[int]]:
    """Groups of tokens whose deviations point the same way: average linkage of their directions, the most alike first."""
    who = sorted({a for a, _, _ in deviations})
    if not who:
        return []
    at = {a: k for k, a in enumerate(who)}
    v = np.zeros((len(who), dims), np.float32)
    for a, b, r in deviations:
        v[at[a], b] = r
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    likeness = (v @ v.T).astype(np.float64)
    size, members = np.ones(len(who)), [[a] for a in who]
    while True:
        mean = np.where(np.outer(size, size) > 0, likeness / np.maximum(np.outer(size, size), 1), -1)
        np.fill_diagonal(mean, -1)
        i, j = np.unravel_index(mean.argmax(), mean.shape)
        if mean[i, j] < LIKENESS:
            return [m for m in members if m]
        likeness[i] += likeness[j]
        likeness[:, i] += likeness[:, j]
        size[i], size[j] = size[i] + size[j], 0
        members[i], members[j] = members[i] + members[j], []


def attributes(rows: DataFrame, total: int) -> tuple[dict[str, tuple[int, int]], frozenset[str]]:
    """(token -> (attribute, class), frequent tokens that are no names). Both are bounded, see FREQUENT; nothing else reaches the driver.

    A frequent token that descriptions follow but that belongs to no attribute is left to the names. A corpus too small for LEAST has no attributes.
    """
    counts = rows.select(each("ws", "w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= max(LEAST, FREQUENT * total))
    frequent = {r.w: (k, r.n) for k, r in enumerate(counts.orderBy(F.desc("n"), "w").collect())}
    words = list(frequent)
    if not words:
        return {}, frozenset()
    met = rows.select("ws", "about").mapInPandas(_met({w: k for w, (k, _) in frequent.items()}), "kind string, a int, b int, n bigint")
    met = cut(met.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    told = met.filter("kind = 'd'")
    beside = {(r.a, r.b): r.n for r in told.filter("a < 0 or b < 0").collect()}
    described = beside.get((-1, -1), 0)
    one = rows.sparkSession.createDataFrame([(a, n) for (a, b), n in beside.items() if b < 0 <= a] or [(0, 0)], "a int, na bigint")
    two = rows.sparkSession.createDataFrame([(b, n) for (a, b), n in beside.items() if a < 0 <= b] or [(0, 0)], "b int, nb bigint")
    chance = F.col("na") * F.col("nb") / F.lit(float(max(described, 1)))
    strong = told.filter("a >= 0 and b >= 0").join(one, "a").join(two, "b").withColumn("r", (F.col("n") - chance) / F.sqrt(F.greatest(chance, F.lit(0.5)))).withColumn("lift", F.log(F.col("n") / chance))
    strong = strong.filter(F.abs("r") >= 2).select("a", "b", "r", "lift").collect()
    telling = {x.a for x in strong if x.r >= DEVIATION and x.lift >= EFFECT}
    groups = classes_of(words, [(x.a, x.b, x.r) for x in strong if x.a in telling], len(words))
    of = {a: k for k, g in enumerate(groups) for a in g}
    together = np.zeros((len(groups), len(groups)))
    if of:
        for r in met.filter("kind = 't'").filter(F.col("a").isin(sorted(of)) & F.col("b").isin(sorted(of))).collect():
            together[of[r.a], of[r.b]] += r.n
    forget(met)
    size = np.array([sum(frequent[words[a]][1] for a in g) for g in groups], float)
    slots: list[list[int]] = []
    for k in sorted(range(len(groups)), key=lambda k: (-size[k], k)):
        ratio = []
        for s, slot in enumerate(slots):
            by_chance = size[k] * size[slot].sum() / total
            if by_chance >= 3 and together[k, slot].sum() <= EXCLUSIVE * by_chance:
                ratio.append((together[k, slot].sum() / by_chance, s))
        if ratio:
            slots[min(ratio)[1]].append(k)
        else:
            slots.append([k])
    kept = [s for s in slots if len(s) > 1 and size[s].sum() >= REACH * total]
    return {words[a]: (s, k) for s, slot in enumerate(kept) for k in slot for a in groups[k]}, frozenset(words) - {words[a] for s in slots if s not in kept for k in s for a in groups[k]}


def _describe(attribute: dict[str, tuple[int, int]], frequent: frozenset[str], slots: int):
    """(values, stated, names, runs): classes by attribute from title, else description; how early the title states one; rare tokens with position, mark and
    whether the description repeats them; and, where it repeats none, the description's runs, of the longer ones the ends, any of which may be a line."""

    @F.pandas_udf("vs array<int>, early double, names array<struct<w: string, at: int, marked: boolean, told: boolean>>, runs string")
    def run(tokens: pd.Series, ats: pd.Series, about: pd.Series) -> pd.DataFrame:
        known = automaton({w: k for k, w in enumerate(attribute)})
        where = list(attribute.values())
        fill = automaton({w: 0 for w in frequent})
        out = []

        @functools.cache
        def stated(d: str) -> list[set]:
            told: list[set] = [set() for _ in range(slots)]
            for *_, v in scan(known, d):
                told[where[v][0]].add(where[v][1])
            return told

        @functools.cache
        def runs(d: str) -> str:
            found = (r for r in _RUN.findall(blank(d, scan(fill, d))) if len(r) > 1)
            return "/".join(dict.fromkeys(r if len(r) <= 2 * LINE else r[:LINE] + r[-LINE:] for r in found))

        for ws, places, d in zip(tokens, ats, about, strict=True):
            title: list[set] = [set() for _ in range(slots)]
            first, names = [], []
            for w, at in zip(ws.split("/"), places.split("/"), strict=True) if ws else ():
                if w in attribute:
                    s, k = attribute[w]
                    title[s].add(k)
                    first.append(int(at.rstrip("+")))
                elif w not in frequent:
                    names.append({"w": w, "at": int(at.rstrip("+")), "marked": at[-1] == "+", "told": bool(d) and w in d})
            told = stated(d) if d and not all(len(t) == 1 for t in title) else [set()] * slots
            values = [next(iter(t)) if len(t) == 1 else next(iter(t & o or o)) if len(t & o or o) == 1 else None for t, o in zip(title, told, strict=True)]
            out.append((values, min(first, default=9) / 10.0, names, runs(d) if d and not any(x["told"] or x["marked"] for x in names) else ""))
        return pd.DataFrame(out, columns=["vs", "early", "names", "runs"])

    return run


# -- 3. names


def lines_of(rows: DataFrame, total: int) -> DataFrame:
    """(id, line, family) of the rows (id, names, runs, described) that have any. Only ids and words meet here, no other column."""
    said = rows.select("id", "described", F.explode("names").alias("x")).select("id", "described", "x.*")
    stats = said.groupBy("w").agg(F.count("*").alias("n"), F.count_if("told").alias("told_n"), F.count_if("marked").alias("marked_n"), F.count_if("described").alias("described_n"))
    # last, a repeated token about which descriptions tell nothing, where it is not one they had many chances to repeat, may be a line
    stats = stats.withColumn("known", (F.col("told_n") + F.col("marked_n") >= 1) & (F.col("told_n") + F.col("marked_n") >= 0.05 * F.col("described_n"))).withColumn("open", F.expr(f"n >= 2 and told_n + marked_n = 0 and described_n < {UNTOLD}"))
    stats = cut(stats.filter("known or n >= 2").select("w", "n", "known", "open", (F.col("marked_n") > 0).alias("line_for_sure")))
    own = cut(said.join(stats, "w").select("id", "w", "n", "known", "open", "line_for_sure", "at", "told", "marked"))
    # a token without affix that stands with each of two and more rarer names again and again is a family
    other = own.filter("known").select("id", F.col("w").alias("v"), F.col("n").alias("vn"))
    families = own.filter("known and not line_for_sure").join(other, "id").filter("w <> v and vn < n").groupBy("w", "v").agg(F.count("*").alias("times")).filter("times >= 2").groupBy("w").agg(F.count("*").alias("lines")).filter("lines >= 2").select("w", F.lit(True).alias("family"))
    families = cut(families)
    # lines that only the description has: the ends of its runs, looked up once for each different run
    lines = stats.filter("known").join(families, "w", "left_anti").select("w", "n")
    runs = rows.select("id", each("runs", "run")).filter("run <> ''")
    sizes = F.sequence(F.lit(2), F.least(F.length("run"), F.lit(LINE)))
    ends = runs.select("run").distinct().select("run", F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.array(F.left("run", k), F.right("run", k)))))).alias("w"))
    line_of = cut(ends.join(lines, "w").groupBy("run").agg(F.max(F.struct(F.length("w").alias("size"), "n", "w")).alias("heard")))
    # most runs are advertising that a thousandth of all listings repeat, so few different ones: those without a line are let go before anything is exchanged
    often = runs.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") >= max(LEAST, FREQUENT * total)).join(line_of, "run", "left_anti").select("run")
    heard = runs.join(F.broadcast(often), "run", "left_anti").join(line_of, "run").select("id", "heard")
    choice = F.struct(F.when(F.col("told"), 0).otherwise(1).alias("t"), F.when(F.col("marked"), 0).otherwise(1).alias("m"), "n", "at", "w")
    shown = own.join(families, "w", "left").select("id", F.when(F.col("known") & F.col("family").isNull(), choice).alias("line"), F.when(F.col("family"), F.struct("at", "w")).alias("family"), F.struct("w", "n", "at", "open").alias("x"))
    both = shown.unionByName(heard, allowMissingColumns=True).groupBy("id").agg(F.min("line").alias("line"), F.min("family").alias("family"), F.max("heard").alias("heard"), F.collect_list("x").alias("xs"))
    both = cut(both.select("id", F.coalesce("line.w", "heard.w").alias("line"), F.col("family.w").alias("family"), "xs"))
    # names that go with one line, in titles that also show it or whose description does
    word = both.select("id", "line", F.explode("xs").alias("x")).select("id", "line", "x.*")
    pairs = word.filter("line is not null and w <> line").groupBy("w", "line").agg(F.count("*").alias("n"))
    stands = pairs.groupBy("w").agg(F.max(F.struct("n", "line")).alias("x"), F.sum("n").alias("all")).filter(F.col("x.n") >= ALIAS * F.col("all")).join(families, "w", "left_anti").select("w", F.struct(F.col("x.n").alias("most"), F.col("x.line").alias("stands")).alias("s"))
    again = word.filter("line is null or line = w").join(stands, "w", "left").filter("s is not null or open")
    again = again.groupBy("id").agg(F.max("s").alias("s"), F.max(F.when(F.col("line").isNull() & F.col("open"), F.struct("n", (-F.col("at")).alias("at"), "w"))).alias("guess"))
    return both.select("id", "line", "family").join(again, "id", "left").select("id", F.coalesce("s.stands", "line", "guess.w").alias("line"), "family")


# -- 4. amounts


def with_made(rows: DataFrame) -> DataFrame:
    """rows with ``made``: the amount in whole base units, an inexact one being the nearest exact one of its line, else the commonest near one of the corpus."""
    rows = rows.withColumn("exact", F.col("error") <= 0.5).withColumn("whole", F.round("qty").cast("bigint")).withColumn("near", F.greatest(F.col("error") / F.col("qty"), F.when(F.col("imperial"), SPREAD).otherwise(0.0)))
    counts = cut(rows.filter("exact and whole > 0").groupBy("line", "uom", "whole").agg(F.count("*").alias("votes")))
    inexact = F.coalesce(~F.col("exact") & (F.col("qty") > 0), F.lit(False))
    loose = rows.filter(inexact).select("line", "uom", "qty", "near").distinct()
    gap = F.abs(F.log(F.col("qty") / F.col("amount")))
    key = ["line", "uom", "qty", "near"]
    of_line = loose.join(counts.filter("line is not null").select("line", "uom", F.col("whole").alias("amount"), "votes"), ["line", "uom"]).filter(gap <= F.col("near") + 1e-9)
    of_line = of_line.groupBy(*key).agg(F.min_by("amount", F.struct(gap, -F.col("votes"), "amount")).alias("here"))
    # buckets as wide as the widest error meet their neighbours
    wide = F.floor(F.log("qty") / SPREAD)
    everywhere = counts.groupBy("uom", "whole").agg(F.sum("votes").alias("votes")).select("uom", F.col("whole").alias("amount"), "votes", F.floor(F.log("whole") / SPREAD).alias("bin"))
    amounts = loose.select("uom", "qty", "near").distinct().withColumn("bin", F.explode(F.array(wide - 1, wide, wide + 1)))
    common = amounts.join(everywhere, ["uom", "bin"]).filter(gap <= F.least(F.col("near"), F.lit(SPREAD)) + 1e-9).groupBy("uom", "qty", "near").agg(F.max_by("amount", F.struct("votes", -gap, "amount")).alias("anywhere"))
    made = cut(loose.join(of_line, key, "left").join(common, key[1:], "left").select(*key, F.coalesce("here", "anywhere").alias("made")).filter("made is not null"))
    line = F.coalesce("line", F.lit(""))  # amounts without a line meet too
    met = rows.filter(inexact).withColumn("line_key", line).join(made.withColumn("line_key", line).drop("line"), ["line_key", *key[1:]], "left").drop("line_key")
    out = met.unionByName(rows.filter(~inexact).withColumn("made", F.lit(None).cast("bigint")))  # exact amounts, most of them, meet nothing
    return out.withColumn("made", F.when(F.col("exact"), F.col("whole")).otherwise(F.coalesce("made", "whole"))).drop("near", "exact", "whole", "error", "imperial")


# -- 5. voting


def _subsets(others: list[str]) -> list[list[str]]:
    """The k-combinations that may name a product: the line with any other tokens, with and without the brand, and where three more tokens are learned the brand with all of them."""
    core = [["line", *c] for k in range(1, len(others) + 1) for c in combinations(others, k)]
    return [[*b, *c] for c in core for b in ([], ["brand"])] + [["brand", "line"]] + ([["brand", *others]] if len(others) > 2 else [])


def _has(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def products(rows: DataFrame, others: list[str]) -> DataFrame:
    """(sku_id, product) from sku_id, brand, line, ``others``, code, article and early."""
    names = ["brand", "line", *others]
    subsets = _subsets(others)
    rows = cut(rows.withColumn("tuple", F.xxhash64(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names], *[F.col(n).isNull() for n in names])))
    stock = cut(rows.groupBy("tuple", *names).agg(F.count("*").alias("votes"), F.avg("early").alias("early")))
    links = cut(rows.select("tuple", F.explode(F.array(F.concat(F.lit("code "), "code"), F.concat(F.lit("article "), "article"))).alias("link")).filter("link is not null").distinct())

    lined, unlined = [c for c in subsets if "line" in c], [c for c in subsets if "line" not in c]
    holds = lambda n: F.col("mask").bitwiseAND(1 << names.index(n)) != 0

    def combinations_of(t: DataFrame, proper: bool, of: list[list[str]]) -> DataFrame:
        """t with a row for each combination that its tokens make: its 64-bit name c and its size k. Proper ones leave some token out."""
        rows = t.withColumn("mask", F.explode(F.array(*[F.lit(sum(1 << names.index(n) for n in c)) for c in of]).cast("array<int>")))
        for n in names:
            rows = rows.filter(~holds(n) | F.col(n).isNotNull())
        if proper:
            rows = rows.filter(functools.reduce(lambda x, y: x | y, [~holds(n) & F.col(n).isNotNull() for n in names]))
        return rows.select("tuple", "votes", "early", F.xxhash64("mask", *[F.when(holds(n), F.col(n)) for n in names]).alias("c"), F.bit_count("mask").alias("k"))

    def vote(anchors: DataFrame, asking: DataFrame, proper: bool) -> DataFrame:
        """(tuple, product): each asking tuple's best combination that holds one anchor only and that none of its own tokens speaks against."""

        def with_links(rows: DataFrame, t: DataFrame) -> DataFrame:
            return rows.unionByName(t.join(links, "tuple").select("tuple", "votes", "early", F.xxhash64("link").alias("c"), F.lit(len(names)).alias("k")))

        # a combination with a line holds anchors of that line only, so anchors of lines that nothing asks for name none with it
        asked = asking.filter("line is not null").select("line").distinct()
        named = combinations_of(anchors.join(asked, "line", "left_semi"), proper, lined).unionByName(combinations_of(anchors, proper, unlined))
        held = with_links(named, anchors).groupBy("c", "k").agg(F.min("tuple").alias("product"), F.max("tuple").alias("last"), F.sum("votes").alias("f"), F.avg("early").alias("p")).filter("product = last")
        mine = with_links(combinations_of(asking, False, subsets), asking).select("tuple", "c")
        found = mine.join(held, "c").filter("product <> tuple").select("tuple", "product", (F.col("k") * F.log1p("f") * (1.5 - F.col("p"))).alias("score"))
        found = found.join(asking.select("tuple", *[F.col(n).alias(f"own_{n}") for n in names]), "tuple").join(anchors.select(F.col("tuple").alias("product"), *names), "product")
        for n in names:
            found = found.filter(F.coalesce(F.col(f"own_{n}") == F.col(n), F.lit(True)))
        return found.groupBy("tuple").agg(F.max_by("product", F.struct("score", "product")).alias("product"))

    full = _has(names)
    whole = stock.filter(full)
    first = cut(vote(whole, stock.filter(~full), False))
    left = cut(stock.filter(~full).join(first, "tuple", "left_anti"))
    # no listing of theirs has all tokens: those with all but the brand are products, the rest votes among what is left
    unbranded = _has(["line", *others])
    second = cut(vote(left.filter(unbranded), left.filter(~unbranded), False))
    rest = left.filter(~unbranded).join(second, "tuple", "left_anti")
    third = cut(vote(rest, rest, True))
    named = first.unionByName(second).unionByName(third)
    enough = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) >= min(3, len(names))
    own = stock.filter(enough & F.col("line").isNotNull()).join(named, "tuple", "left_anti").select("tuple", F.col("tuple").alias("product"))
    # what a tuple of the rest joins may itself have joined another
    above = named.select(F.col("tuple").alias("product"), F.col("product").alias("above"))
    named = named.join(above, "product", "left").select("tuple", F.coalesce("above", "product").alias("product"))
    return rows.select("sku_id", "tuple").join(named.unionByName(own), "tuple").select("sku_id", "product")


def listing_tokens(listings: DataFrame, brand_ref: DataFrame, unit_ref: DataFrame) -> tuple[DataFrame, list[str]]:
    """(sku_id, brand, line, one column for each learned attribute, made, code, article, early) of every listing, and the attributes' names."""
    spark = listings.sparkSession
    release(spark)
    names = brand_names(brand_ref)
    listed = read_listings(listings, names, unit_ref)
    total = max(listed.count(), 1)
    units, affixes, phrases = lexicon(listed, total)
    rows = cut(tokens(listed, units, affixes, phrases, total))
    forget(units)
    attribute, frequent = attributes(rows, total)
    release(spark)
    slots = max((s for s, _ in attribute.values()), default=-1) + 1
    # where no attribute is learned, only titles of equal words are one product
    words = [] if attribute else [F.array_join(F.array_sort(F.split("ws", "/")), " ").alias("words")]
    told = rows.withColumn("d", _describe(attribute, frequent, slots)("ws", "ats", "about"))
    told = cut(told.select("id", F.coalesce(F.length("about") > 0, F.lit(False)).alias("described"), *words, "d.*"))
    forget(rows)
    # what is looked up goes by id, and the listings' own columns meet it once
    lines = lines_of(told, total)
    release(spark)
    unsure = listed.filter((F.size("shown") != 1) & F.col("entry").isNotNull()).select("id", "entry")
    brands = resolve(unsure.select("entry").distinct(), "entry", brand_ref).filter("brand_id <> 0").select(F.col("raw").alias("entry"), "brand_id")
    brands = unsure.join(brands, "entry").select("id", "brand_id")
    brand = F.when(F.size("shown") == 1, F.col("shown")[0].cast("string")).otherwise(F.coalesce(F.when((F.size("shown") == 0) | F.array_contains("shown", F.col("brand_id")), F.col("brand_id").cast("string")), "family"))
    lined = listed.drop("entry", "pieces", "words", "about").join(told.drop("names", "runs", "described"), "id").join(lines, "id", "left").join(brands, "id", "left")
    lined = cut(lined.withColumn("brand", brand).drop("id", "shown", "family", "brand_id"))
    forget(listed, told)
    if slots > 1 and lined.filter("line is not null").count() < REACH * total:
        # few lines, each in many listings, are learned as values of the attribute with the most values
        sizes = [len({k for t, k in attribute.values() if t == s}) for s in range(slots)]
        most = sizes.index(max(sizes))
        lined = lined.withColumn("line", F.col("vs")[most].cast("string")).withColumn("vs", F.concat(F.slice("vs", 1, most), F.slice("vs", most + 2, slots)))
        slots -= 1
    release(spark)
    out = with_made(lined)
    values = [f"attribute_{s}" for s in range(slots)]
    out = out.select("sku_id", "brand", F.col("line" if attribute else "words").alias("line"), *[F.col("vs")[s].alias(v) for s, v in enumerate(values)], F.when(F.col("made").isNotNull(), F.concat(F.col("made").cast("string"), F.lit(" "), F.col("uom"))).alias("made"), "code", "article", "early")
    return out, [*values, "made"]


def listing_products(listings: DataFrame, brand_ref: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """(sku_id, product) of all listings whose product can be told; see p5_found for pairs."""
    return products(*listing_tokens(listings, brand_ref, unit_ref))


def p5_found(listings: DataFrame, brand_ref: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """(sku_a, sku_b): each pair of listings of the same product, sku_a < sku_b.

    The pairs are the result that is asked for; ``listing_products`` is the form without them.
    """
    p = cut(listing_products(listings, brand_ref, unit_ref))
    many = p.groupBy("product").agg(F.count("*").alias("n")).filter("n > 1").select("product")
    p = p.join(many, "product", "left_semi")
    return p.select("product", F.col("sku_id").alias("sku_a")).join(p.select("product", F.col("sku_id").alias("sku_b")), "product").filter("sku_a < sku_b").select("sku_a", "sku_b")
