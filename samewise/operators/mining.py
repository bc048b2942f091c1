"""Mining of variant terms: vocabulary, signatures, mutually exclusive terms, vetoes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.config import DEFAULT_PACK, DEFAULTS, DomainPack, Thresholds
from samewise.functions import text as T
from samewise.functions.text import let
from samewise.session import cut, forget


def substrings(c: str) -> Column:
    """All distinct parts of a text column, itself included."""
    return F.array_distinct(let(F.col(c), lambda t: F.flatten(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.transform(F.sequence(F.lit(1), F.length(t) - i + 1), lambda n: F.substring(t, i, n))))))


def mining_key(merchant: Column | None = None) -> Column:
    """Group of an attribute record: brand key, else brand id, else merchant with form and content."""
    merchant = F.substring("sku_id", 1, 5) if merchant is None else merchant
    nobody = F.concat_ws(":", F.lit("NB"), merchant, "form", F.concat(F.coalesce(F.col("unit_value").cast("string"), F.lit("?")), F.coalesce("unit_uom", F.lit("?"))))
    return F.coalesce(F.nullif("brand_key", F.lit("")), F.nullif("brand_id", F.lit("")), nobody)


def term_lists(attributes: DataFrame, pack: DomainPack = DEFAULT_PACK) -> DataFrame:
    """(sku_id, grp, title, terms) of attribute records."""
    return attributes.select("sku_id", mining_key().alias("grp"), F.col("clean_title").alias("title"), T.tokens("title", "brand_raw", pack=pack).alias("terms"))


def document_frequency(terms: DataFrame, column: str = "terms") -> DataFrame:
    """(term, df) over the distinct terms of each row."""
    return terms.select(F.explode(F.array_distinct(column)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n_rows: int | Column) -> DataFrame:
    """(term, df, idf) with idf = ln((n + 1) / (df + 1)) + 1; a term that is not there counts as df 0."""
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    return df.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def split_counts(terms: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(term, splits): groups of at least min_split_group rows in which at least min_brand_count, but not all rows have the term."""
    sizes = terms.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") >= t.min_split_group)
    inside = terms.select("grp", F.explode(F.array_distinct("terms")).alias("term")).groupBy("grp", "term").agg(F.count("*").alias("df"))
    return inside.join(sizes, "grp").filter((F.col("df") >= t.min_brand_count) & (F.col("df") < F.col("size"))).groupBy("term").agg(F.count("*").alias("splits"))


def drop_fragments(vocabulary: DataFrame) -> DataFrame:
    """(term, df) without terms that a longer term of the same frequency contains: every part of a term meets the term in an equi-join on part and frequency."""
    inner = vocabulary.filter(F.length("term") >= 2).select("df", "term", F.explode(substrings("term")).alias("part")).filter("part <> term").select(F.col("part").alias("term"), "df").distinct()
    return vocabulary.join(inner, ["term", "df"], "left_anti")


def vocabulary(terms: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(term, df): terms that split a group and stand in at most max_global_df of all rows, without fragments."""
    n = terms.agg(F.count("*").alias("n"))
    common = document_frequency(terms).crossJoin(F.broadcast(n)).filter(F.col("df") <= t.max_global_df * F.col("n")).drop("n")
    return drop_fragments(common.join(split_counts(terms, t), "term", "left_semi"))


def maximal(c: Column) -> Column:
    """The terms of an array that no other of its terms contains, sorted."""
    return F.array_sort(F.filter(c, lambda x: ~F.exists(c, lambda y: (y != x) & F.contains(y, x))))


def signatures(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(sku_id, grp, title, signature): the maximal vocabulary terms of each row, [] for none."""
    hits = terms.select("sku_id", F.explode(F.array_distinct("terms")).alias("term")).join(vocab.select("term"), "term").groupBy("sku_id").agg(F.collect_set("term").alias("hits"))
    hits = hits.select("sku_id", maximal(F.col("hits")).alias("signature"))
    return terms.drop("terms").join(hits, "sku_id", "left").withColumn("signature", F.coalesce("signature", F.array().cast("array<string>")))


def alternative_pairs(terms: DataFrame, vocab: DataFrame, t: Thresholds = DEFAULTS, least: int = 1, without: DataFrame | None = None) -> DataFrame:
    """(t1, t2, support): groups (of min_alternative_group rows) in which both terms stand twice or more and never together, in at least ``least`` groups. No closure.

    Support is the number of groups in which both stand twice or more, less those in which some row has both. It is counted inside tasks (``meetings``),
    so the pairs of a group are never rows; only terms of one row are. Terms frequent in fewer than ``least`` groups are left out before they meet.
    Terms and groups are numbers meanwhile. ``without`` (t1, t2) are pairs that are not asked for.
    """
    big = terms.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") >= t.min_alternative_group).select("grp")
    frequent = terms.join(big, "grp", "left_semi").select("grp", F.explode(F.array_distinct("terms")).alias("term")).groupBy("grp", "term").agg(F.count("*").alias("df")).filter(F.col("df") >= t.min_brand_count)
    frequent = cut(frequent.select("grp", "term").join(vocab.select("term"), "term", "left_semi"))
    able = frequent.groupBy("term").agg(F.count("*").alias("groups")).filter(F.col("groups") >= least).select("term")
    names = cut(able.withColumn("id", F.monotonically_increasing_id()))
    groups = cut(frequent.select("grp").distinct().withColumn("g", F.monotonically_increasing_id()))
    keyed = cut(frequent.join(names, "term").join(groups, "grp"))
    forget(frequent, groups)
    rows = terms.select(F.monotonically_increasing_id().alias("row"), "grp", "terms").select("row", "grp", F.explode(F.array_distinct("terms")).alias("term"))
    rows = rows.join(keyed, ["grp", "term"]).groupBy("row", "g").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1)
    apart = rows.select("g", "ids", F.explode("ids").alias("a")).select("g", "a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    if without is not None:
        x, y = (names.select(F.col("term").alias(f"t{k}"), F.col("id").alias(f"id{k}")) for k in (1, 2))
        apart = apart.unionByName(without.join(x, "t1").join(y, "t2").select(F.lit(None).cast("bigint").alias("g"), F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")))
    return meetings(keyed, names, apart, least)


#: Terms of groups in one part of ``meetings``, and pairs that a task counts at a time.
PART_TERMS, PAIRS_AT_ONCE = 1_000_000, 4_000_000


def meetings(keyed: DataFrame, names: DataFrame, apart: DataFrame, least: int = 1) -> DataFrame:
    """(t1, t2, support): pairs of terms of ``names`` (term, id) that are in at least ``least`` groups of ``keyed`` (g, id) together, without those groups that
    ``apart`` (g, a, b; a < b) names for the pair; a null g stands for every group.

    Ids are dealt into parts, and each two parts meet in one task, which holds their ids group by group; it counts the pairs of a few ids at a time.
    """
    n = keyed.count()
    parts = min(8, 1 + n // 10_000) + n // PART_TERMS
    part = lambda c: F.pmod(c, F.lit(parts)).cast("int")
    block = lambda p, q: F.least(p, q) * parts + F.greatest(p, q)
    lists = keyed.select("g", "id", F.lit(None).cast("string").alias("term")).unionByName(names.select(F.lit(None).cast("bigint").alias("g"), "id", "term"))
    lists = lists.groupBy("g", part(F.col("id")).alias("part")).agg(F.collect_list("id").alias("ids"), F.collect_list("term").alias("terms"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(block("part", "other").alias("block"), (F.col("part") <= F.col("other")).alias("first"), "g", "ids", "terms")
    apart = apart.select(block(part(F.col("a")), part(F.col("b"))).alias("block"), F.col("g").alias("of"), F.col("a").alias("x"), F.col("b").alias("y"))

    def meet(table: pa.Table, taken: pa.Table) -> pa.Table:
        found = [pa.table({"t1": pa.array([], pa.string()), "t2": pa.array([], pa.string()), "support": pa.array([], pa.int64())})]
        if not len(table):
            return found[0]
        key = table.column("block")[0].as_py()
        same = key // parts == key % parts
        named = pc.is_null(table.column("g"))
        known = table.filter(named)
        ids, terms = (pc.list_flatten(known.column(c)).combine_chunks() for c in ("ids", "terms"))
        order = np.argsort(ids.to_numpy())
        known, terms = ids.to_numpy()[order], terms.take(pa.array(order))
        table = table.filter(pc.invert(named))
        lengths = pc.list_value_length(table.column("ids")).to_numpy()
        ids, g = pc.list_flatten(table.column("ids")).to_numpy(), np.repeat(table.column("g").to_numpy(), lengths)
        ids = np.searchsorted(known, ids)  # numbers of the block, in the order of the ids
        left = np.repeat(table.column("first").to_numpy(), lengths)
        right = left if same else ~left
        if not left.any() or not right.any():
            return found[0]
        # ids of the first part in their order, those of the second group by group and numbered from 0
        a, ag, b, bg = ids[left], g[left], ids[right], g[right]
        order = np.argsort(a, kind="stable")
        a, ag = a[order], ag[order]
        order = np.argsort(bg, kind="stable")
        others, rank = np.unique(b[order], return_inverse=True)
        bg = bg[order]
        begin, size = np.searchsorted(bg, ag, "left"), np.searchsorted(bg, ag, "right") - np.searchsorted(bg, ag, "left")
        # pairs taken from: how many groups each, all for a null g
        width = len(known)
        asked, every = taken.column("of"), len(g) + 1
        x, y = (np.searchsorted(known, taken.column(c).to_numpy()) for c in "xy")
        pair, null = x * width + y, pc.is_null(asked).to_numpy()
        pair, group = np.r_[pair[~null], pair[null]], np.r_[pc.drop_null(asked).to_numpy().astype(np.int64), np.full(null.sum(), -1)]
        order = np.lexsort((group, pair))
        pair, group = pair[order], group[order]
        new = np.r_[True, (pair[1:] != pair[:-1]) | (group[1:] != group[:-1])][: len(pair)]
        pair, weight = pair[new], np.where(group[new] < 0, every, 1)
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        pair, weight = pair[starts], np.add.reduceat(weight, starts) if len(starts) else weight
        edges = np.r_[np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a)]
        pairs, i = np.r_[0, size.cumsum()][edges], 0
        while i + 1 < len(edges):
            j = max(i + 1, int(np.searchsorted(pairs, pairs[i] + PAIRS_AT_ONCE, "right")) - 1)
            s = slice(edges[i], edges[j])
            took = size[s]
            at = np.arange(took.sum()) + np.repeat(begin[s] - (took.cumsum() - took), took)
            keys = np.sort(np.repeat(a[s] * len(others), took) + rank[at])
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            count, keys = np.diff(np.r_[new, len(keys)]), keys[new]
            x, y = keys // len(others), others[keys % len(others)]
            keep = (count >= least) & (x < y if same else True)
            x, y, count = x[keep], y[keep], count[keep]
            key = np.minimum(x, y) * width + np.maximum(x, y)
            if len(pair):
                where = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
                count = count - np.where(pair[where] == key, weight[where], 0)
                x, y, count = x[count >= least], y[count >= least], count[count >= least]
            x, y = terms.take(pa.array(x)), terms.take(pa.array(y))
            less = pc.less(x, y)
            found.append(pa.table({"t1": pc.if_else(less, x, y), "t2": pc.if_else(less, y, x), "support": pa.array(count, pa.int64())}))
            i = j
        return pa.concat_tables(found)

    return lists.groupBy("block").cogroup(apart.groupBy("block")).applyInArrow(meet, "t1 string, t2 string, support bigint")


def minimal_pairs(sigs: DataFrame) -> DataFrame:
    """(t1, t2): terms by which alone two titles of a group differ. Titles meet on group and folded title without the term.

    Most titles meet none. Those are told by a hash of what they would meet on, so that long texts move only for the rest; equal titles meet as one.
    """
    rest = F.replace("folded", F.col("term"), F.lit(""))
    one = sigs.select("grp", "sku_id", F.explode("signature").alias("term"), T.fold("title").alias("folded")).select("sku_id", "term", "grp", rest.alias("rest")).filter("rest <> ''")
    shared = one.select(F.xxhash64("grp", "rest").alias("key"), "sku_id", "term").withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").select("sku_id", "term")
    one = sigs.join(shared, "sku_id").withColumn("folded", T.fold("title")).select("grp", rest.alias("rest"), "term", "signature").distinct()
    a, b = (one.select("grp", "rest", F.col("term").alias(f"t{k}"), F.col("signature").alias(f"s{k}")) for k in (1, 2))
    one_each = (F.size(F.array_except("s1", "s2")) == 1) & (F.size(F.array_except("s2", "s1")) == 1) & ~F.array_contains("s2", F.col("t1")) & ~F.array_contains("s1", F.col("t2"))
    return a.join(b, ["grp", "rest"]).filter(F.col("t1") < F.col("t2")).filter(one_each).select("t1", "t2").distinct()


def contradicted_pairs(sigs: DataFrame, positives: DataFrame) -> DataFrame:
    """(t1, t2): terms by which two listings of one code differ, so wordings of the same."""
    s = sigs.select("sku_id", "signature")
    both = positives.join(s.select(F.col("sku_id").alias("sku_a"), F.col("signature").alias("sa")), "sku_a").join(s.select(F.col("sku_id").alias("sku_b"), F.col("signature").alias("sb")), "sku_b")
    return both.select(F.explode(F.array_except("sa", "sb")).alias("x"), F.array_except("sb", "sa").alias("ys")).select("x", F.explode("ys").alias("y")).select(F.least("x", "y").alias("t1"), F.greatest("x", "y").alias("t2")).distinct()


def veto_pairs(alternative: DataFrame, minimal: DataFrame, contradicted: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(t1, t2): well supported alternatives and minimal pairs, without what codes contradict."""
    return alternative.filter(F.col("support") >= t.veto_support).select("t1", "t2").unionByName(minimal).distinct().join(contradicted, ["t1", "t2"], "left_anti")


def vetoes(terms: DataFrame, vocab: DataFrame, sigs: DataFrame, positives: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """``veto_pairs`` of what is mined. The few minimal and contradicted pairs are known before alternatives are counted, so that these, many more, need no other step."""
    minimal, contradicted = cut(minimal_pairs(sigs)), cut(contradicted_pairs(sigs, positives))
    alternative = alternative_pairs(terms, vocab, t, t.veto_support, minimal.unionByName(contradicted).distinct())
    return alternative.select("t1", "t2").unionByName(minimal.join(contradicted, ["t1", "t2"], "left_anti"))


def veto_terms(veto: DataFrame) -> DataFrame:
    return veto.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()


def clean_signatures(sigs: DataFrame, core: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(sku_id, clean): each signature term as the shortest core term inside it; else kept if rare or part of a core term; else dropped.

    Substrings meet core terms in equi-joins both ways; no theta join.
    """
    terms = sigs.select("sku_id", F.explode("signature").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    inside = df.select(F.col("term").alias("x")).select("x", F.explode(substrings("x")).alias("core")).join(core.select(F.col("term").alias("core")), "core").groupBy(F.col("x").alias("term")).agg(F.min(F.struct(F.length("core"), "core")).getField("core").alias("to"))
    within = core.select(F.col("term").alias("x")).select(F.explode(substrings("x")).alias("term")).distinct()
    mapped = df.join(inside, "term", "left").join(within.withColumn("part", F.lit(True)), "term", "left").select("term", F.coalesce("to", F.when((F.col("df") <= t.low_df) | F.col("part"), F.col("term"))).alias("to")).filter("to is not null")
    got = terms.join(mapped, "term").groupBy("sku_id").agg(F.array_sort(F.collect_set("to")).alias("clean"))
    return sigs.select("sku_id").join(got, "sku_id", "left").withColumn("clean", F.coalesce("clean", F.array().cast("array<string>")))


def expand(sigs: DataFrame, core: DataFrame) -> DataFrame:
    """(sku_id, expanded): array of (term, forms): each signature term with the core terms inside it."""
    terms = sigs.select(F.explode("signature").alias("term")).distinct()
    forms = terms.select("term", F.explode(substrings("term")).alias("core")).join(core.select(F.col("term").alias("core")), "core", "left_semi").groupBy("term").agg(F.collect_set("core").alias("cores"))
    forms = terms.join(forms, "term", "left").select("term", F.array_union(F.array("term"), F.coalesce("cores", F.array().cast("array<string>"))).alias("forms"))
    return sigs.select("sku_id", F.explode_outer("signature").alias("term")).join(forms, "term", "left").groupBy("sku_id").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", F.array_sort("forms").alias("forms")))).alias("expanded"))


def variant_conflicts(pairs: DataFrame, sigs: DataFrame, veto: DataFrame) -> DataFrame:
    """(sku_a, sku_b): pairs of which one side's own term and the other's are an excluded pair.

    Terms are expanded to the excluded terms inside them. Forms that both sides reach are no evidence, nor are two that share such a form.
    """
    core = veto_terms(veto)
    e = expand(sigs, core)
    s = sigs.select("sku_id", "signature").join(e, "sku_id")
    own = lambda side, other: F.array_distinct(F.flatten(F.transform(F.filter(F.col(f"e{side}"), lambda x: ~F.array_contains(F.col(f"s{other}"), x["term"])), lambda x: x["forms"])))
    both = pairs.select("sku_a", "sku_b")
    for side in "ab":
        both = both.join(s.select(F.col("sku_id").alias(f"sku_{side}"), F.col("signature").alias(f"s{side}"), F.col("expanded").alias(f"e{side}")), f"sku_{side}")
    both = both.select("sku_a", "sku_b", own("a", "b").alias("fa"), own("b", "a").alias("fb")).withColumn("common", F.array_intersect("fa", "fb"))
    x = both.select("sku_a", "sku_b", "common", F.explode(F.array_except("fa", "common")).alias("x"), F.array_except("fb", "common").alias("ys")).select("sku_a", "sku_b", "common", "x", F.explode("ys").alias("y"))
    x = x.withColumn("t1", F.least("x", "y")).withColumn("t2", F.greatest("x", "y")).join(veto, ["t1", "t2"], "left_semi")
    return x.filter(~F.exists("common", lambda c: F.contains(F.col("x"), c) & F.contains(F.col("y"), c))).select("sku_a", "sku_b").distinct()


def variant_asymmetry(sa: Column, sb: Column, known: Column) -> Column:
    """Known terms that only the richer side has, over all its terms: 0 for equal signatures, 1 where one side says nothing of what the other knows."""
    more, less = F.when(F.size(sa) >= F.size(sb), sa).otherwise(sb), F.when(F.size(sa) >= F.size(sb), sb).otherwise(sa)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_except(more, less), known)), F.size(more)), F.lit(0.0)).cast("double")


def variant_compatible(sa: Column, sb: Column, ra: Column, rb: Column, conflict: Column, known: Column, tau: float = 0.34, tau_rest: float = 0.60) -> Column:
    """The older rule, kept for comparison: no conflict, no one-sided known term, and enough overlap of signatures, or of residual terms where neither has one."""
    j = lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))
    one_sided = F.arrays_overlap(F.concat(F.array_except(sa, sb), F.array_except(sb, sa)), known)
    return ~conflict & ~F.coalesce(one_sided, F.lit(False)) & F.when((F.size(sa) > 0) & (F.size(sb) > 0), j(sa, sb) >= tau).when((F.size(sa) == 0) & (F.size(sb) == 0), (F.size(ra) > 0) & (F.size(rb) > 0) & (j(ra, rb) >= tau_rest)).otherwise(False)
