"""The core's registered queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise import oracle as O
from samewise.config import DEFAULT_PACK, DEFAULTS
from samewise.functions import extract as X
from samewise.functions import text as T
from samewise.operators import attributes as A
from samewise.operators import candidates as C
from samewise.operators import cluster as K
from samewise.operators import evaluate as E
from samewise.operators import features as FE
from samewise.operators import identity as I
from samewise.operators import images as IM
from samewise.operators import labels as L
from samewise.operators import mining as M
from samewise.operators import model as B
from samewise.operators import naming as N
from samewise.operators import quantities
from samewise.operators import vectors as V
from samewise.session import cut, table
from samewise.sources import io
from samewise.sources import records as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Text pieces that both engines share.
FOLD = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_%]+', '', 'g')"
FIRST = "(select * from listings where sku_id is not null qualify row_number() over (partition by sku_id order by row_ord) = 1)"
GRAMS = "list_sort(list_distinct([substring({0}, i, 2) for i in range(1, length({0}))]))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _listings(spark: SparkSession, d: str) -> DataFrame:
    return A.latest(table(spark, d, "listings"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Listings with keys made of their own columns: brand, title key, merchant, main place."""
    return _listings(spark, d).select("sku_id", "row_ord", "category_code", "sku_name_chi", "brand_name_chi", "origin_chi", F.lower(F.trim("brand_name_chi")).alias("brand"), F.nullif(T.fold("sku_name_chi"), F.lit("")).alias("title_key"), F.substring("sku_id", 1, 5).alias("merchant"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """label_pairs, repeated rows once."""
    return table(spark, d, "label_pairs").select("sku_a", "sku_b", "label").distinct()


def _best_scores(spark: SparkSession, d: str) -> DataFrame:
    """One row for each unordered pair of candidate_pairs with its best score (null where all are vetoed)."""
    return table(spark, d, "candidate_pairs").filter("sku_a is not null and sku_b is not null and sku_a <> sku_b").groupBy(F.least("sku_a", "sku_b").alias("sku_a"), F.greatest("sku_a", "sku_b").alias("sku_b")).agg(F.max("score").alias("score"), F.max("embedding_cosine").alias("cosine"))


BEST = "(select least(sku_a, sku_b) sku_a, greatest(sku_a, sku_b) sku_b, max(score) score, max(embedding_cosine) cosine from candidate_pairs where sku_a is not null and sku_b is not null and sku_a <> sku_b group by 1, 2)"
LABELS = "(select distinct sku_a, sku_b, label from label_pairs)"


@query()
def p6_found(spark, d):
    return quantities.p6_found(table(spark, d, "listings"), table(spark, d, "sku_groups"), table(spark, d, "unit_ref"))


@query()
def p6_contents(spark, d):
    return quantities.p6_contents(table(spark, d, "listings"), table(spark, d, "sku_groups"), table(spark, d, "unit_ref"))


# -- text


@query(f"select doc_id, {FOLD.format("coalesce(text, '')")} as folded from documents")
def q_fold_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold("text").alias("folded"))


@query(f"with f as (select doc_id, {FOLD.format('text')} k from documents where text is not null) select min(doc_id) as root, count(*) as members from f where k <> '' group by k having count(*) > 1")
def q_exact_dup_groups(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", F.nullif(T.fold("text"), F.lit("")).alias("k")).filter("k is not null")
    return keyed.groupBy("k").agg(F.min("doc_id").alias("root"), F.count("*").alias("members")).filter("members > 1").select("root", "members")


@query(f"with t as (select sku_id, {FOLD.format('sku_name_chi')} f from {FIRST} where sku_name_chi is not null) select sku_id, len({GRAMS.format('f')}) as grams, coalesce({GRAMS.format('f')}[1], '') as least_gram from t")
def q_char_ngrams(spark, d):
    return _listings(spark, d).filter("sku_name_chi is not null").select("sku_id", T.char_ngrams("sku_name_chi").alias("g")).select("sku_id", F.size("g").cast("bigint").alias("grams"), F.coalesce(F.try_element_at("g", F.lit(1)), F.lit("")).alias("least_gram"))


@query("select sku_id, right(trim(list_extract(string_split_regex(coalesce(sku_name_chi, ''), '[-–—|｜:：]'), -1), ' '), 12) as tail from " + FIRST)
def q_tail_text(spark, d):
    return _listings(spark, d).select("sku_id", T.tail_text("sku_name_chi").alias("tail"))


@query(
    f"""with k as (select sku_id, {FOLD.format("coalesce(sku_name_chi, '')")} f from {FIRST}),
    p as (select b.sku_a, b.sku_b, x.f fa, y.f fb from {BEST} b join k x on x.sku_id = b.sku_a join k y on y.sku_id = b.sku_b)
    select sku_a, sku_b, round(case when fa = '' or fb = '' then 0 else len(list_filter(range(1, least(length(fa), length(fb)) + 1), lambda i: starts_with(fb, substring(fa, 1, i)))) / greatest(length(fa), length(fb))::double end, 6) as lcp,
    round(case when greatest(length(fa), length(fb)) = 0 then 0 else least(length(fa), length(fb)) / greatest(length(fa), length(fb))::double end, 6) as len_ratio from p"""
)
def q_lcp_ratio(spark, d):
    k = _listings(spark, d).select("sku_id", T.fold("sku_name_chi").alias("f"))
    p = _best_scores(spark, d).select("sku_a", "sku_b").join(k.withColumnsRenamed({"sku_id": "sku_a", "f": "fa"}), "sku_a").join(k.withColumnsRenamed({"sku_id": "sku_b", "f": "fb"}), "sku_b")
    longest = F.greatest(F.length("fa"), F.length("fb"))
    return p.select("sku_a", "sku_b", F.round(T.lcp_ratio("fa", "fb"), 6).alias("lcp"), F.round(F.when(longest == 0, 0.0).otherwise(F.least(F.length("fa"), F.length("fb")) / longest), 6).alias("len_ratio"))


# -- attributes

@query(
    f"""with v as (select merchant, origin_chi, count(*) votes, min(row_ord) f from (select substring(sku_id, 1, 5) merchant, * from {FIRST}) where origin_chi is not null group by 1, 2)
    select merchant, origin_chi, votes from v qualify row_number() over (partition by merchant order by votes desc, f, origin_chi) = 1"""
)
def q_majority_value(spark, d):
    return A.majority(_rows(spark, d), "merchant", "origin_chi", "row_ord")


@query("select user_id, arg_min(event_type, event_id) as event_type from events group by user_id")
def q_first_wins(spark, d):
    return A.first_wins(table(spark, d, "events"), "user_id", "event_type", "event_id")


# -- frequencies and mining

def _mined(spark, d):
    attrs = cut(A.build_attributes(table(spark, d, "listings")))
    terms = cut(M.term_lists(attrs))
    vocab = cut(M.vocabulary(terms))
    return attrs, terms, vocab, cut(M.signatures(terms, vocab))


# -- candidates

BLOCKED = f"(select sku_id, lower(trim(brand_name_chi)) brand, nullif({FOLD.format('sku_name_chi')}, '') title_key, substring(sku_id, 1, 5) merchant, category_code from {FIRST})"


def _keyed(spark, d) -> DataFrame:
    r = _rows(spark, d)
    return r.withColumns({"form": F.lit("UNKNOWN"), "unit_value": F.lit(None).cast("double"), "unit_uom": F.lit(None).cast("string"), "origin": F.array().cast("array<string>")})


@query("select p.p_partkey as a, q.p_partkey as b from part p join part q on p.p_brand = q.p_brand and p.p_name = q.p_name and p.p_partkey < q.p_partkey where abs(p.p_size - q.p_size) / greatest(p.p_size, q.p_size)::double <= 0.1")
def q_block_size_tolerant(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.col("p_size").cast("double").alias("v"))
    a, b = p.select(F.col("p_partkey").alias("a"), "p_brand", "p_name", F.col("v").alias("va")), p.select(F.col("p_partkey").alias("b"), "p_brand", "p_name", F.col("v").alias("vb"))
    return a.join(b, ["p_brand", "p_name"]).filter("a < b").filter(X.unit_compatible(F.col("va"), F.lit("g"), F.col("vb"), F.lit("g"))).select("a", "b")


@query("select source, count(*) as pairs from (select distinct sku_a, sku_b, unnest(string_split(sources, ';')) source from candidate_pairs where sources is not null and sku_a is not null and sku_b is not null) group by source")
def q_source_counts(spark, d):
    rows = table(spark, d, "candidate_pairs").filter("sources is not null and sku_a is not null and sku_b is not null").select("sku_a", "sku_b", F.explode(F.split("sources", ";")).alias("source")).distinct()
    return C.source_counts(rows.select("sku_a", "sku_b", F.array("source").alias("sources")))


@query(
    f"""with k as {BLOCKED}, n as (select brand, count(*) c from k where brand is not null group by 1), n2 as (select brand, merchant, count(*) c from k where brand is not null and merchant is not null group by 1, 2), pos as (select distinct sku_a, sku_b from label_pairs where label = 1),
    j as (select x.brand ba, y.brand bb, x.merchant ma, y.merchant mb from pos left join k x on x.sku_id = sku_a left join k y on y.sku_id = sku_b)
    select 'brand' as scheme, (select coalesce(sum(c * (c - 1) / 2), 0)::bigint from n) as pairs, round(coalesce(sum((ba = bb)::int), 0) / count(*), 6) as recall from j
    union all select 'brand_merchant', (select coalesce(sum(c * (c - 1) / 2), 0)::bigint from n2), round(coalesce(sum((ba = bb and ma = mb)::int), 0) / count(*), 6) from j"""
)
def q_block_recall(spark, d):
    pos = _labels(spark, d).filter("label = 1")
    return E.block_recall(_rows(spark, d), {"brand": ["brand"], "brand_merchant": ["brand", "merchant"]}, pos)


@query(f"with k as {BLOCKED} select block_size, count(*) as blocks, count(*) * block_size * (block_size - 1) / 2.0 as pairs from (select count(*) block_size from k group by brand, merchant) group by block_size")
def q_block_sizes(spark, d):
    return C.block_sizes(_rows(spark, d), "brand", "merchant").withColumn("pairs", F.col("pairs").cast("double"))


# -- vectors


@query(
    """with q as (select vec_id id, embedding::double[] v from embeddings where vec_id % 100 = 0), p as (select q.id, e.vec_id neighbour, list_dot_product(q.v, e.embedding::double[]) c from q join embeddings e on e.vec_id <> q.id)
    select id, neighbour, round(c, 5) as cosine, row_number() over (partition by id order by c desc, neighbour) as rank from p qualify rank <= 20"""
)
def q_cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    near = V.exact_top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 20)
    return near.select("id", "neighbour", F.round("cosine", 5).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


@query(
    """with p as (select a.vec_id id, a.label la, b.label lb, row_number() over (partition by a.vec_id order by list_dot_product(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)
    select la as label, round(avg((la = lb)::int), 6) as agreement, count(*) as n from p where r <= 5 group by la"""
)
def q_knn_label_agreement(spark, d):
    e = table(spark, d, "embeddings")
    near = V.exact_top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)
    labels = e.select("vec_id", "label")
    both = near.join(labels.withColumnsRenamed({"vec_id": "id", "label": "la"}), "id").join(labels.withColumnsRenamed({"vec_id": "neighbour", "label": "lb"}), "neighbour")
    return both.groupBy(F.col("la").alias("label")).agg(F.round(F.avg((F.col("la") == F.col("lb")).cast("int")), 6).alias("agreement"), F.count("*").alias("n"))


@query()
def q_ivf_topk(spark, d):
    e = table(spark, d, "embeddings")
    return V.ivf_top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 20)


TERMS = "(list_transform(regexp_extract_all(lower(t), '[a-z]+'), lambda w: 'w:' || w) || " + " || ".join(f"[('c{n}:' || substring(f, i, {n})) for i in range(1, length(f) - {n - 2})]" for n in (2, 3, 4)) + ")"


@query(
    f"""with t as (select sku_id, coalesce(sku_name_chi, '') t, {FOLD.format("coalesce(sku_name_chi, '')")} f from {FIRST}), h as (select sku_id, md5(x) h from (select sku_id, unnest({TERMS}) x from t)),
    b as (select sku_id, ('0x' || substring(h, 1, 8))::bigint % 4096 bucket, case when ('0x' || substring(h, 9, 1))::bigint % 2 = 0 then 1 else -1 end s from h),
    tf as (select sku_id, bucket, sign(sum(s)) * ln(1 + abs(sum(s))) tf from b group by 1, 2 having sum(s) <> 0), i as (select bucket, ln(((select count(*) from t) + 1) / (count(*) + 1)) + 1 idf from tf group by 1),
    w as (select sku_id, tf.bucket, tf * idf w from tf join i on i.bucket = tf.bucket), n as (select sku_id, sqrt(sum(w * w)) norm from w group by 1)
    select w.sku_id, bucket, round(w / norm, 6) as w from w join n on n.sku_id = w.sku_id"""
)
def q_hashed_tfidf(spark, d):
    v = V.hashed_tfidf(_listings(spark, d).select("sku_id", F.coalesce("sku_name_chi", F.lit("")).alias("t")), "sku_id", "t")
    return v.select("sku_id", "bucket", F.round("w", 6).alias("w"))


# -- pair features

PAIRED = f"(select b.sku_a, b.sku_b, {FOLD.format("coalesce(x.sku_name_chi, '')")} fa, {FOLD.format("coalesce(y.sku_name_chi, '')")} fb from {BEST} b join {FIRST} x on x.sku_id = b.sku_a join {FIRST} y on y.sku_id = b.sku_b)"


def _gram_pairs(spark, d) -> DataFrame:
    g = _listings(spark, d).select("sku_id", T.char_ngrams(F.coalesce("sku_name_chi", F.lit(""))).alias("g"))
    return _best_scores(spark, d).join(g.withColumnsRenamed({"sku_id": "sku_a", "g": "ga"}), "sku_a").join(g.withColumnsRenamed({"sku_id": "sku_b", "g": "gb"}), "sku_b")


@query(f"with p as {PAIRED}, g as (select sku_a, sku_b, {GRAMS.format('fa')} ga, {GRAMS.format('fb')} gb from p) select sku_a, sku_b, round(case when len(list_distinct(ga || gb)) = 0 then 0 else len(list_intersect(ga, gb)) / len(list_distinct(ga || gb))::double end, 6) as jaccard from g")
def q_bigram_jaccard(spark, d):
    return _gram_pairs(spark, d).select("sku_a", "sku_b", F.round(FE.jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard"))


@query(
    f"""with p as {PAIRED}, t as (select sku_id, unnest({GRAMS.format('f')}) g from (select sku_id, {FOLD.format("coalesce(sku_name_chi, '')")} f from {FIRST})), i as (select g, ln(((select count(*) from {FIRST}) + 1) / (count(*) + 1)) + 1 w from t group by g),
    s as (select sku_id, sum(w) s from t join i on i.g = t.g group by 1), c as (select p.sku_a, p.sku_b, sum(w) c from p join t x on x.sku_id = p.sku_a join t y on y.sku_id = p.sku_b and y.g = x.g join i on i.g = x.g group by 1, 2)
    select p.sku_a, p.sku_b, round(coalesce(c / nullif(coalesce(a.s, 0) + coalesce(b.s, 0) - c, 0), 0), 5) as similarity from p left join c on c.sku_a = p.sku_a and c.sku_b = p.sku_b left join s a on a.sku_id = p.sku_a left join s b on b.sku_id = p.sku_b"""
)
def q_weighted_jaccard(spark, d):
    g = _listings(spark, d).select("sku_id", T.char_ngrams(F.coalesce("sku_name_chi", F.lit(""))).alias("g"))
    n = g.agg(F.count("*").alias("n"))
    idf = M.document_frequency(g, "g").crossJoin(F.broadcast(n)).transform(lambda x: M.idf(x, F.col("n"))).select("term", "idf")
    w = FE.with_weights(g, "g", idf)
    p = _best_scores(spark, d).join(w.withColumnsRenamed({"sku_id": "sku_a", "g": "ga", "weights": "wa"}), "sku_a").join(w.withColumnsRenamed({"sku_id": "sku_b", "g": "gb", "weights": "wb"}), "sku_b")
    both = F.map_zip_with("wa", "wb", lambda k, x, y: F.coalesce(x, y))
    return p.withColumn("w", both).select("sku_a", "sku_b", F.round(FE.weighted_jaccard(F.col("ga"), F.col("gb"), F.col("w"), F.lit(0.0)), 5).alias("similarity"))


# -- labels and evaluation


@query(
    """with g as (select sku_id, brand_canonical, product_form, unit, pack_count, sku_name from sku_groups where unit is not null and unit <> '' and brand_canonical is not null and brand_canonical <> '' and sku_name is not null)
    select a.sku_id as sku_a, b.sku_id as sku_b from g a join g b on a.brand_canonical = b.brand_canonical and a.product_form = b.product_form and a.unit = b.unit and a.sku_name = b.sku_name and a.sku_id < b.sku_id and a.pack_count <> b.pack_count"""
)
def q_pack_invariance_pairs(spark, d):
    g = table(spark, d, "sku_groups").filter("unit is not null and unit <> '' and brand_canonical is not null and brand_canonical <> '' and sku_name is not null")
    rows = g.select("sku_id", F.col("brand_canonical").alias("brand_id"), F.hash("unit").cast("double").alias("unit_value"), F.col("unit").alias("unit_uom"), F.col("product_form").alias("form"), "pack_count", F.array().cast("array<string>").alias("origin"))
    return L.pack_invariance(rows, g.select("sku_id", F.array("sku_name").alias("signature")))


@query(
    f"""with j as (select label, coalesce(score, -1) s from {LABELS} l join {BEST} b on b.sku_a = l.sku_a and b.sku_b = l.sku_b), r as (select label, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 r from j)
    select round((sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) as auc, coalesce(sum(label), 0)::bigint as positives, coalesce(sum(1 - label), 0)::bigint as negatives from r"""
)
def q_mid_rank_auc(spark, d):
    j = _labels(spark, d).join(_best_scores(spark, d), ["sku_a", "sku_b"]).select("label", F.coalesce("score", F.lit(-1.0)).alias("s"))
    return E.auc(j, "label", "s").select(F.col("auc").cast("double"), "positives", "negatives")


@query(
    f"""with j as (select label, coalesce(score, -1) s from {LABELS} l join {BEST} b on b.sku_a = l.sku_a and b.sku_b = l.sku_b), t as (select unnest([0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99])::double threshold),
    c as (select threshold, count_if(s >= threshold and label = 1) tp, count_if(s >= threshold and label <> 1) fp, count_if(s < threshold and label = 1) fn, count_if(s < threshold and label <> 1) tn from j, t group by 1)
    select threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall from c"""
)
def q_threshold_curve(spark, d):
    return E.score_curve(_labels(spark, d).join(_best_scores(spark, d), ["sku_a", "sku_b"]))


_GROUPED = "(select sku_id, group_id cluster from sku_groups where group_id is not null)"


@query(
    """with g as (select sku_id, group_id from sku_groups where group_id is not null), t as (select sku_id, nullif(product_form, 'UNKNOWN') form from sku_groups where group_id is not null), b as (select g.sku_id, g.group_id, t.form from g join t on t.sku_id = g.sku_id where form is not null),
    n as (select group_id, form, count(*) n from b group by 1, 2), x as (select n, sum(n) over (partition by group_id) nc, sum(n) over (partition by form) nl from n) select round(sum(n * n / nc) / sum(n), 6) as precision, round(sum(n * n / nl) / sum(n), 6) as recall from x"""
)
def q_b_cubed(spark, d):
    g = table(spark, d, "sku_groups").filter("group_id is not null")
    return E.b_cubed(g.select("sku_id", F.col("group_id").alias("cluster")), g.select("sku_id", F.nullif("product_form", F.lit("UNKNOWN")).alias("label")).filter("label is not null"))


@query(
    """with g as (select group_id, count(distinct case when product_form <> 'UNKNOWN' then product_form end) f, count(distinct nullif(unit, '')) u, bool_or(product_form = 'soap_bar') s, bool_or(product_form = 'body_wash') w from sku_groups group by 1)
    select 'one form' as "check", count_if(f > 1)::bigint as faults from g union all select 'one unit', count_if(u > 1)::bigint from g union all select 'bars apart from washes', count_if(coalesce(s, false) and coalesce(w, false))::bigint from g"""
)
def q_mixed_variant_check(spark, d):
    g = table(spark, d, "sku_groups")
    checks = [E.one_label_per_group(g, F.nullif("product_form", F.lit("UNKNOWN")), "one form"), E.one_label_per_group(g, F.nullif("unit", F.lit("")), "one unit"), E.disjoint(g, F.col("product_form") == "soap_bar", F.col("product_form") == "body_wash", "bars apart from washes")]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query(
    f"""with l as (select *, regexp_matches(sku_id, '_[0-9]{{13}}') has from {FIRST}) select field, round(avg(case when has then v end), 6) as with_code, round(avg(case when not has then v end), 6) as without_code
    from (select has, 'brand' field, (brand_name_chi is not null)::int v from l union all select has, 'pack_size', (pack_size_chi is not null)::int from l union all select has, 'origin', (origin_chi is not null)::int from l) group by field"""
)
def q_bias_rates(spark, d):
    rows = _listings(spark, d)
    return E.selection_bias(rows, F.col("sku_id").rlike("_[0-9]{13}"), {"brand": F.col("brand_name_chi").isNotNull(), "pack_size": F.col("pack_size_chi").isNotNull(), "origin": F.col("origin_chi").isNotNull()})


@query(
    f"""with p as {PAIRED}, g as (select sku_a, sku_b, {GRAMS.format('fa')} ga, {GRAMS.format('fb')} gb from p), j as (select g.sku_a, g.sku_b, coalesce(len(list_intersect(ga, gb)) / nullif(len(list_distinct(ga || gb)), 0)::double, 0) j from g), t as (select unnest([0.5, 0.6, 0.7, 0.8])::double threshold),
    pos as (select distinct sku_a, sku_b from label_pairs where label = 1) select threshold, count(*) as pairs, round(count(pos.sku_a) / (select count(*) from pos)::double, 6) as recall from j join t on j.j >= threshold left join pos on pos.sku_a = j.sku_a and pos.sku_b = j.sku_b group by threshold"""
)
def q_jaccard_sweep(spark, d):
    return E.block_similarity_sweep(_gram_pairs(spark, d), _labels(spark, d).filter("label = 1"))


# -- clusters, ids, names


@query(
    """with recursive e as (select sku_a a, sku_b b from candidate_pairs where score >= 0.8 and sku_a <> sku_b union select sku_b, sku_a from candidate_pairs where score >= 0.8 and sku_a <> sku_b), r(x, y) as (select distinct a, a from e union select r.x, e.b from r join e on r.y = e.a)
    select x as member, min(y) as component from r group by x"""
)
def q_connected_components(spark, d):
    return K.connected_components(table(spark, d, "candidate_pairs").filter("score >= 0.8"))


def _scores(spark, d) -> DataFrame:
    s = _best_scores(spark, d)
    return s.select("sku_a", "sku_b", "score", F.col("score").isNull().alias("vetoed"), F.coalesce(F.col("score") >= 0.999, F.lit(False)).alias("must"))


@query()
def q_constrained_clusters(spark, d):
    return K.constrained_clusters(_rows(spark, d), _scores(spark, d), 0.8)


@query(
    f"""with n as (select sku_id, brand || '|' || coalesce(title_key, '') c from {BLOCKED} where brand is not null), o as (select distinct sku_id, group_id g from sku_groups where group_id is not null), a as (select c, count(distinct sku_id) na from n group by 1), b as (select g, count(*) nb from o group by 1)
    select n.c as cluster, o.g as previous_group_id, count(*) as shared, round(count(*) / least(any_value(na), any_value(nb))::double, 6) as containment, round(count(*) / (any_value(na) + any_value(nb) - count(*))::double, 6) as jaccard from n join o on o.sku_id = n.sku_id join a on a.c = n.c join b on b.g = o.g group by 1, 2"""
)
def q_lineage_overlap(spark, d):
    new = _rows(spark, d).filter("brand is not null").select("sku_id", F.concat_ws("|", "brand", F.coalesce("title_key", F.lit(""))).alias("cluster"))
    return I.overlaps(new, table(spark, d, "sku_groups")).withColumns({"containment": F.round("containment", 6), "jaccard": F.round("jaccard", 6)})


@query()
def q_assigned_ids(spark, d):
    new = _rows(spark, d).select("sku_id", F.concat_ws("|", F.coalesce("brand", F.lit("")), F.coalesce("title_key", F.lit(""))).alias("cluster"))
    return I.assign_ids(new, table(spark, d, "sku_groups"))[1]


@query("select group_id as cluster, 'G_' || substring(sha256(array_to_string(list_sort(list_distinct(list(sku_id))), chr(31))), 1, 16) as group_id from sku_groups where group_id is not null group by group_id")
def q_stable_ids(spark, d):
    g = table(spark, d, "sku_groups").filter("group_id is not null").select("sku_id", F.col("group_id").alias("cluster"))
    return I.fingerprints(g, separator="\x1f")


@query(
    """with g as (select group_id, any_value(n) n from (select group_id, first_value(group_name) over (partition by group_id order by sku_id) n from sku_groups where group_id is not null) group by 1), c as (select *, count(*) over (partition by n) k, n || ' #' || substring(group_id, 1, 6) s from g),
    x as (select *, case when k > 1 then s else n end m from c) select group_id, case when count(*) over (partition by m) > 1 then n || ' #' || group_id else m end as name from x"""
)
def q_unique_names(spark, d):
    g = table(spark, d, "sku_groups").filter("group_id is not null").groupBy("group_id").agg(F.min_by("group_name", "sku_id").alias("name"))
    return N.suffix_names(g).select("group_id", "name")


@query()
def q_gbdt_scores(spark, d):
    feats = ["jaccard", "cosine", "len_ratio"]
    p = _gram_pairs(spark, d)
    x = p.select("sku_a", "sku_b", FE.jaccard(F.col("ga"), F.col("gb")).alias("jaccard"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce(F.try_divide(F.least(F.size("ga"), F.size("gb")), F.greatest(F.size("ga"), F.size("gb"))), F.lit(0.0)).cast("double").alias("len_ratio"))
    labelled = L.class_weight(x.join(_labels(spark, d), ["sku_a", "sku_b"]).withColumn("fold", F.pmod(F.xxhash64("sku_a"), F.lit(5)).cast("int")))
    models = B.fit_by_fold(labelled, feats)
    if not models:
        return x.limit(0).withColumn("probability", F.lit(0.0))
    return B.score(x, models, feats).select("sku_a", "sku_b", "probability")


# -- attribute records and what is derived from them, against SQL written anew


def _attrs(spark, d) -> DataFrame:
    return cut(A.build_attributes(table(spark, d, "listings")))


@query(f"select sku_id, {O.clean('t')} as clean, {O.packfree('t')} as packfree, length(t) + length(regexp_replace(t, '[^ᄀ-ᅟ⺀-〾ぁ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]', '', 'g')) as width from (select sku_id, {O.nfkc('sku_name_chi')} t from {FIRST})")
def q_clean_titles(spark, d):
    return _listings(spark, d).select("sku_id", T.nfkc("sku_name_chi").alias("t")).select("sku_id", T.clean_title("t").alias("clean"), T.packfree("t").alias("packfree"), T.display_width("t").cast("bigint").alias("width"))


@query(O.select("select * from attr"))
def q_attributes(spark, d):
    return A.build_attributes(table(spark, d, "listings"))


@query(O.select("select sku_id, unnest(ean) as ean from attr"))
def q_ean_codes(spark, d):
    n = _listings(spark, d).select("sku_id", *[T.nfkc(c).alias(c) for c in ("sku_name_chi", "summary_chi", "pack_size_chi", "description_chi")])
    return n.select("sku_id", F.explode(X.eans("sku_id", "sku_name_chi", "summary_chi", "pack_size_chi", "description_chi")).alias("ean"))


_SUFFIXED = f"""e as (select sku_id, row_ord, lower(coalesce(brand_name_chi, '')) b, list_sort(list_distinct(list_filter(string_split(sku_id, '_'), lambda c: {O.valid_ean("c")}))) ean from {FIRST}), g as (select group_id, min(e.ean[1]) m from sku_groups s join e on e.sku_id = s.sku_id where len(e.ean) > 0 group by 1),
    asked as (select e.*, right(m, 5) code from e join (select distinct sku_id, group_id from sku_groups) s on s.sku_id = e.sku_id join g on g.group_id = s.group_id where len(ean) = 0), pool as (select x, arg_min(b, row_ord) filter (where b <> '') eb from (select unnest(ean) x, b, row_ord from e) group by x)"""


@query(f"with {_SUFFIXED} select a.sku_id, list_sort(list_distinct(list(x))) as ean_all, 'propagated' as ean_source from asked a join pool on right(x, 5) = code where b = '' or coalesce(eb, '') = '' or eb = b group by 1")
def q_propagated_codes(spark, d):
    """Listings without a code get those that end like the least code of their group."""
    rows = _listings(spark, d).select("sku_id", "row_ord", F.lower(F.coalesce("brand_name_chi", F.lit(""))).alias("brand_key"), X.eans("sku_id").alias("ean"))
    groups = table(spark, d, "sku_groups").select("sku_id", "group_id").distinct()
    least = rows.filter(F.size("ean") > 0).join(groups, "sku_id").groupBy("group_id").agg(F.min(F.array_min("ean")).alias("m"))
    codes = groups.join(least, "group_id").select("sku_id", F.array(F.right("m", F.lit(5))).alias("codes"))
    out = X.propagate_eans(rows.join(codes, "sku_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))))
    return out.filter("ean_source = 'propagated'").select("sku_id", "ean_all", "ean_source")


@query(f"select sku_id, list_sort(list_distinct(list_filter(regexp_extract_all(t, {O.quoted(X.MARKED)}, 1) || regexp_extract_all(t, {O.quoted(X.BRACKETED)}, 1), lambda e: length(e) between 4 and 6))) as codes from (select sku_id, {O.nfkc('sku_name_chi')} t from {FIRST})")
def q_short_codes(spark, d):
    return _listings(spark, d).select("sku_id", T.nfkc("sku_name_chi").alias("t")).select("sku_id", X.short_codes("t").alias("codes"))


@query(O.select("select sku_id, origin from attr"))
def q_origins(spark, d):
    return _listings(spark, d).select("sku_id", T.nfkc("origin_chi").alias("o")).select("sku_id", X.origins("o").alias("origin"))


@query(f"select sku_id, {O.brand_key('b')} as brand_key, {O.brand_key('b')} = '' as no_brand from (select sku_id, {O.nfkc('brand_name_chi')} b from {FIRST})")
def q_brand_keys(spark, d):
    return _listings(spark, d).select("sku_id", T.nfkc("brand_name_chi").alias("b")).select("sku_id", X.brand_key("b").alias("brand_key"), X.is_non_brand("b").alias("no_brand"))


@query(O.select("select form, form_source, form_conf, count(*) as listings from attr group by all"))
def q_form_distribution(spark, d):
    n = _listings(spark, d).select(T.nfkc("sku_name_chi").alias("n"), T.nfkc("summary_chi").alias("s"))
    return n.select(X.form_of(F.col("n"), F.col("s")).alias("f")).groupBy(F.col("f.form").alias("form"), F.col("f.source").alias("form_source"), F.col("f.conf").alias("form_conf")).agg(F.count("*").alias("listings"))


_RULED = f"select {O.form('t')} f, list_filter([{', '.join(f"case when regexp_matches(t, {O.quoted(f'(?:{p})')}, 'i') then {O.quoted(n)} end" for n, p in DEFAULT_PACK.forms)}], lambda x: x is not null) h from (select coalesce(sku_name_chi, '') t from {FIRST})"


@query(f"with r as ({_RULED}) select rule, sum(f)::bigint as first, sum(a)::bigint as hits from (select coalesce(f, 'UNKNOWN') rule, 1 f, 0 a from r union all select unnest(h), 0, 1 from r union all select 'SEVERAL', 1, 0 from r where len(h) > 1) group by 1")
def q_rule_distribution(spark, d):
    return E.rule_distribution(_listings(spark, d).withColumn("t", F.coalesce("sku_name_chi", F.lit(""))), "t", DEFAULT_PACK.forms).select("rule", F.col("first").cast("bigint").alias("first"), F.col("hits").cast("bigint").alias("hits"))


@query(O.select("select sku_id, unit_value, unit_uom, unit_source, pack_count from attr"))
def q_extract_unit(spark, d):
    names = ("sku_name_chi", "pack_size_chi", "summary_chi", "description_chi")
    n = _listings(spark, d).select("sku_id", *[T.nfkc(c).alias(c) for c in names])
    texts = {"name": T.clean_title("sku_name_chi"), "pack_size": F.col("pack_size_chi"), "summary": F.col("summary_chi"), "description": F.col("description_chi")}
    u = F.coalesce(*[F.when(x.isNotNull(), F.struct(x["value"].alias("v"), x["uom"].alias("u"), x["n"].alias("n"), F.lit(k).alias("s"))) for k, x in ((k, X.unit_of(t)) for k, t in texts.items())])
    n = n.select("sku_id", u.alias("u"), X.pack_count("sku_name_chi", "pack_size_chi").alias("told"))
    return n.select("sku_id", F.col("u.v").alias("unit_value"), F.col("u.u").alias("unit_uom"), F.col("u.s").alias("unit_source"), F.coalesce("u.n", "told").alias("pack_count"))


@query(
    """with done as (select sku_id, nullif(group_name, '') clean_title, product_form, pack_count from sku_groups union all select sku_a, null, 'UNKNOWN', 1 from label_pairs union all select 'added', 'x', 'UNKNOWN', 1), want as (select distinct sku_id from listings where sku_id is not null)
    select * from (select 'missing' as fault, (select count(*) from want w where not exists (select 1 from done x where x.sku_id = w.sku_id)) as n union all select 'added', (select count(*) from done x where not exists (select 1 from want w where w.sku_id = x.sku_id))
    union all select 'repeated', (select count(*) from (select sku_id from done group by 1 having count(*) > 1)) union all select 'null', (select count(*) from done where clean_title is null or product_form is null or pack_count is null)) where n > 0"""
)
def q_processed_faults(spark, d):
    """A processed table with lost, added, repeated and incomplete rows."""
    g = table(spark, d, "sku_groups").select("sku_id", F.nullif("group_name", F.lit("")).alias("clean_title"), "product_form", "pack_count")
    more = table(spark, d, "label_pairs").select(F.col("sku_a").alias("sku_id"), F.lit(None).cast("string").alias("clean_title"), F.lit("UNKNOWN").alias("product_form"), F.lit(1).alias("pack_count"))
    added = spark.createDataFrame([("added", "x", "UNKNOWN", 1)], "sku_id string, clean_title string, product_form string, pack_count int")
    return A.processed_faults(table(spark, d, "listings"), g.unionByName(more).unionByName(added))


@query(O.select("select l.sku_id, l.main_image_url, a.clean_title, array_to_string(a.ean_all, ';') as ean, a.ean_source, a.brand_canonical, a.unit_value, a.pack_count, a.form as product_form, array_to_string(a.origin, '/') as origin_normalized, array_to_string(s.signature, ';') as variant_signature from " + FIRST + " l join attr a on a.sku_id = l.sku_id join sig s on s.sku_id = l.sku_id", O.terms(), O.mined()))
def q_processed(spark, d):
    attrs, _, _, sigs = _mined(spark, d)
    return A.processed(table(spark, d, "listings"), attrs, sigs.select("sku_id", "signature")).select("sku_id", "main_image_url", "clean_title", "ean", "ean_source", "brand_canonical", "unit_value", "pack_count", "product_form", "origin_normalized", "variant_signature")


# -- terms and mining


@query(O.select("select sku_id, grp, term from term", O.terms()))
def q_term_lists(spark, d):
    return M.term_lists(_attrs(spark, d)).select("sku_id", "grp", F.explode("terms").alias("term"))


@query(O.select("select term, df, round(ln(((select count(*) from listed) + 1) / (df + 1)) + 1, 6) as idf from freq", O.terms(), O.mined()))
def q_idf(spark, d):
    terms = cut(M.term_lists(_attrs(spark, d)))
    n = terms.agg(F.count("*").alias("n"))
    return M.document_frequency(terms).crossJoin(F.broadcast(n)).transform(lambda x: M.idf(x, F.col("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(O.select("select term, df from vocab", O.terms(), O.mined()))
def q_vocabulary(spark, d):
    return M.vocabulary(cut(M.term_lists(_attrs(spark, d))))


@query(O.select("select sku_id, signature from sig", O.terms(), O.mined()))
def q_signatures(spark, d):
    return _mined(spark, d)[3].select("sku_id", "signature")


@query(O.select("select t1, t2, support from alt", O.terms(), O.mined(), O.vetoes()))
def q_alternative_pairs(spark, d):
    _, terms, vocab, _ = _mined(spark, d)
    return M.alternative_pairs(terms, vocab)


@query(O.select("select 'minimal' as kind, t1, t2 from minimal union all select 'contradicted', t1, t2 from contra", O.terms(), O.mined(), O.vetoes()))
def q_minimal_and_contradicted_pairs(spark, d):
    attrs, _, _, sigs = _mined(spark, d)
    kind = lambda k, x: x.select(F.lit(k).alias("kind"), "t1", "t2")
    return kind("minimal", M.minimal_pairs(sigs)).unionByName(kind("contradicted", M.contradicted_pairs(sigs, L.positives(attrs))))


@query(O.select("select t1, t2 from veto", O.terms(), O.mined(), O.vetoes()))
def q_variant_vetoes(spark, d):
    attrs, terms, vocab, sigs = _mined(spark, d)
    return M.vetoes(terms, vocab, sigs, L.positives(attrs))


_CORE = f"""core as (select distinct t term from (select t1 t from veto union select t2 from veto)), sdf as (select term, count(*) df from (select unnest(signature) term from sig) group by 1),
    shortest as (select s.term, arg_min(c.term, (length(c.term), c.term)) target from sdf s join core c on contains(s.term, c.term) group by 1),
    mapping as (select s.term, coalesce(h.target, case when s.df <= {DEFAULTS.low_df} or exists (select 1 from core c where contains(c.term, s.term)) then s.term end) target from sdf s left join shortest h on h.term = s.term)"""


@query(O.select("select s.sku_id, coalesce(c.clean, []) as clean from sig s left join (select sku_id, list_sort(list_distinct(list(m.target))) clean from (select sku_id, unnest(signature) term from sig) x join mapping m on m.term = x.term where m.target is not null group by 1) c on c.sku_id = s.sku_id", O.terms(), O.mined(), O.vetoes(), _CORE))
def q_clean_signatures(spark, d):
    attrs, terms, vocab, sigs = _mined(spark, d)
    veto = cut(M.vetoes(terms, vocab, sigs, L.positives(attrs)))
    return M.clean_signatures(sigs, M.veto_terms(veto))


_CONFLICTS = f"""forms as (select s.term, list_distinct([s.term] || coalesce(list(c.term) filter (where c.term is not null), [])) f from sdf s left join core c on contains(s.term, c.term) group by 1),
    sides2 as (select b.sku_a, b.sku_b, list_filter(x.signature, lambda q: not list_contains(y.signature, q)) xs, list_filter(y.signature, lambda q: not list_contains(x.signature, q)) ys from {BEST} b join sig x on x.sku_id = b.sku_a join sig y on y.sku_id = b.sku_b),
    fa as (select distinct sku_a, sku_b, unnest(f) q from (select sku_a, sku_b, unnest(xs) t from sides2) u join forms on forms.term = u.t), fb as (select distinct sku_a, sku_b, unnest(f) q from (select sku_a, sku_b, unnest(ys) t from sides2) u join forms on forms.term = u.t),
    both2 as (select fa.sku_a, fa.sku_b, fa.q from fa join fb on fa.sku_a = fb.sku_a and fa.sku_b = fb.sku_b and fa.q = fb.q), xa as (select fa.* from fa anti join both2 on fa.sku_a = both2.sku_a and fa.sku_b = both2.sku_b and fa.q = both2.q), xb as (select fb.* from fb anti join both2 on fb.sku_a = both2.sku_a and fb.sku_b = both2.sku_b and fb.q = both2.q),
    conflict as (select distinct xa.sku_a, xa.sku_b from xa join xb on xa.sku_a = xb.sku_a and xa.sku_b = xb.sku_b join veto v on v.t1 = least(xa.q, xb.q) and v.t2 = greatest(xa.q, xb.q)
        where not exists (select 1 from both2 c where c.sku_a = xa.sku_a and c.sku_b = xa.sku_b and contains(xa.q, c.q) and contains(xb.q, c.q)))"""


@query(O.select("select sku_a, sku_b from conflict", O.terms(), O.mined(), O.vetoes(), _CORE, _CONFLICTS))
def q_variant_conflicts(spark, d):
    attrs, terms, vocab, sigs = _mined(spark, d)
    veto = cut(M.vetoes(terms, vocab, sigs, L.positives(attrs)))
    return M.variant_conflicts(_best_scores(spark, d), sigs, veto)


# -- channels over attribute records

_EAN = "select distinct a.sku_id sku_a, b.sku_id sku_b, 'exact_ean' source from (select sku_id, unnest(ean_all) e from attr) a join (select sku_id, unnest(ean_all) e from attr) b on a.e = b.e and a.sku_id < b.sku_id"
_BLOCK = f"select a.sku_id sku_a, b.sku_id sku_b, 'legacy_block' source from attr a join attr b on coalesce(nullif(a.brand_id, ''), '<NB>') = coalesce(nullif(b.brand_id, ''), '<NB>') and a.unit_value is not distinct from b.unit_value and a.unit_uom is not distinct from b.unit_uom and a.sku_id < b.sku_id where {O.compatible()}"
_BRAND = f"select a.sku_id sku_a, b.sku_id sku_b, 'brand_unit' source from attr a join attr b on a.brand_key = b.brand_key and a.brand_key <> '' and a.sku_id < b.sku_id where {O.compatible()}"
_KEYS = f"keyed as (select *, {O.fold(O.packfree('title'))} k from attr)"
_TITLE = f"select a.sku_id sku_a, b.sku_id sku_b, 'title_key' source from keyed a join keyed b on a.k = b.k and a.k <> '' and a.sku_id < b.sku_id where {O.compatible()}"


@query(O.select(f"select sku_a, sku_b from ({_EAN})"))
def q_exact_ean(spark, d):
    return C.exact_ean(_attrs(spark, d)).select("sku_a", "sku_b")


@query(O.select(f"select sku_a, sku_b from ({_BLOCK})"))
def q_legacy_block(spark, d):
    return C.legacy_block(_attrs(spark, d)).select("sku_a", "sku_b")


@query(O.select(f"select sku_a, sku_b from ({_BRAND})"))
def q_brand_block(spark, d):
    return C.brand_block(_attrs(spark, d)).select("sku_a", "sku_b")


@query(O.select(f"select sku_a, sku_b from ({_TITLE})", _KEYS))
def q_block_title(spark, d):
    return C.title_key(_attrs(spark, d)).select("sku_a", "sku_b")


@query(O.select(f"select sku_a, sku_b, array_to_string(list_sort(list_distinct(list(source))), ';') as sources, bool_or(source not in ('exact_ean', 'legacy_block')) as honest from ({_EAN} union all {_BLOCK} union all {_BRAND} union all {_TITLE}) group by 1, 2", _KEYS))
def q_candidate_union(spark, d):
    """All channels that need no vectors."""
    return C.generate(_attrs(spark, d)).select("sku_a", "sku_b", F.array_join("sources", ";").alias("sources"), C.is_honest().alias("honest"))


@query(O.select(f"""select b.sku_a, b.sku_b, not (x.form = 'UNKNOWN' or y.form = 'UNKNOWN' or x.form = y.form) or (x.unit_value is not null and y.unit_value is not null and not {O.same_unit('x', 'y')}) or not {O.origins_meet('x', 'y')}
    or (x.pack_count > 1 and regexp_matches(regexp_replace(x.title, '[(（\\[【][^)）\\]】]*[)）\\]】]', '', 'g'), '[+＋]')) <> (y.pack_count > 1 and regexp_matches(regexp_replace(y.title, '[(（\\[【][^)）\\]】]*[)）\\]】]', '', 'g'), '[+＋]')) as vetoed from {BEST} b join attr x on x.sku_id = b.sku_a join attr y on y.sku_id = b.sku_b"""))
def q_hard_vetoes(spark, d):
    attrs = cut(R.without_records(_attrs(spark, d)))
    p = _best_scores(spark, d).select("sku_a", "sku_b")
    for s in "ab":
        p = p.join(attrs.select(*[F.col(c).alias(f"{s}_{c}") for c in attrs.columns]), F.col(f"sku_{s}") == F.col(f"{s}_sku_id"))
    return p.select("sku_a", "sku_b", FE.hard_veto().alias("vetoed"))


# -- labels over attribute records

_POS = "pos as (select distinct a.sku_id sku_a, b.sku_id sku_b from (select sku_id, unnest(ean) e from attr) a join (select sku_id, unnest(ean) e from attr) b on a.e = b.e and a.sku_id < b.sku_id)"
_NEG = f"neg as (select a.sku_id sku_a, b.sku_id sku_b from attr a join attr b on a.brand_key = b.brand_key and a.brand_key <> '' and a.sku_id < b.sku_id where len(a.ean) > 0 and len(b.ean) > 0 and not list_has_any(a.ean, b.ean) and a.pack_count = b.pack_count and {O.same_unit()})"
_INVARIANT = f"""invariant as (select a.sku_id sku_a, b.sku_id sku_b from attr a join attr b on a.brand_id = b.brand_id and a.brand_id <> '' and a.unit_value = b.unit_value and a.unit_uom = b.unit_uom and a.form = b.form and a.sku_id < b.sku_id
    join sig x on x.sku_id = a.sku_id join sig y on y.sku_id = b.sku_id where x.signature = y.signature and len(x.signature) > 0 and a.pack_count <> b.pack_count and {O.origins_meet('a', 'b')})"""


@query(O.select("select sku_a, sku_b from pos", _POS))
def q_positive_pairs(spark, d):
    return L.positives(_attrs(spark, d))


@query(O.select("select sku_a, sku_b from neg", _NEG))
def q_negative_pairs(spark, d):
    attrs = _attrs(spark, d)
    return L.negatives(attrs, L.positives(attrs))


@query(O.select("select sku_a, sku_b from invariant", O.terms(), O.mined(), _INVARIANT))
def q_pack_invariance(spark, d):
    attrs, _, _, sigs = _mined(spark, d)
    return L.pack_invariance(attrs, sigs)


@query(O.select(f"""select l.sku_a, l.sku_b, l.label, x.fold, round(case when l.label = 1 then coalesce((count(*) over () - sum(l.label) over ()) / nullif(sum(l.label) over (), 0), 1.0) else 1.0 end, 6) as weight
    from (select distinct sku_a, sku_b, label from (select sku_a, sku_b, 1 label from pos union all select sku_a, sku_b, 0 from neg)) l join folds x on x.sku_id = l.sku_a join folds y on y.sku_id = l.sku_b where x.fold = y.fold""", _POS, _NEG, "folds as (select sku_id, (('0x' || substring(sha1(list_min(ean)), 1, 12))::bigint % 5)::int fold from attr where len(ean) > 0)"))
def q_folded_labels(spark, d):
    attrs = _attrs(spark, d)
    pos = L.positives(attrs)
    labels = pos.withColumn("label", F.lit(1)).unionByName(L.negatives(attrs, pos).withColumn("label", F.lit(0)))
    return L.class_weight(L.same_fold(labels, attrs)).select("sku_a", "sku_b", "label", "fold", F.round("weight", 6).alias("weight"))


@query(O.select(f"""select (select count(*) from (select cluster from g group by 1)) as n_groups, (select max(c) from (select count(*) c from g group by cluster)) as max_group, round(coalesce((select avg(same) from jp), 0), 6) as recall, round(coalesce((select avg(same) from jn), 0), 6) as merge_rate,
    round(coalesce((select sum(same) from jp) / nullif((select sum(same) from jp) + (select sum(same) from jn), 0), 0), 6) as precision, round(coalesce((select avg(same) from ji), 0), 6) as pack_invariance, (select count(*) from ji) as pack_n, round(coalesce((select avg((exists (select 1 from {BEST} b where b.sku_a = p.sku_a and b.sku_b = p.sku_b))::int) from pos p), 0), 6) as candidate_recall""",
    O.terms(), O.mined(), _POS, _NEG, _INVARIANT, "g as (select sku_id, group_id cluster from sku_groups where group_id is not null)", *[f"{j} as (select coalesce(x.cluster = y.cluster, false)::int same from {t} p left join g x on x.sku_id = p.sku_a left join g y on y.sku_id = p.sku_b)" for j, t in (("jp", "pos"), ("jn", "neg"), ("ji", "invariant"))]))
def q_group_metrics(spark, d):
    attrs, _, _, sigs = _mined(spark, d)
    g = table(spark, d, "sku_groups").filter("group_id is not null").select("sku_id", F.col("group_id").alias("cluster"))
    pos = cut(L.positives(attrs))
    m = E.metrics(g, pos, L.negatives(attrs, pos), L.pack_invariance(attrs, sigs), _best_scores(spark, d))
    return m.select("n_groups", "max_group", "pack_n", *[F.round(c, 6).alias(c) for c in ("recall", "merge_rate", "precision", "pack_invariance", "candidate_recall")])


@query(O.select("""select sku_id, 'A_' || substring(h, 1, 12) as group_id from (select sku_id, c from comp) m join (select c, sha1(concat_ws('|', min(form), coalesce(min(brand_id), '?'), coalesce(min(unit_value)::decimal(30, 6)::varchar, '?'), c)) h from comp join attr a using (sku_id) group by c) i using (c)""",
    """ready as (select * from attr where brand_id <> '' and unit_value is not null and form <> 'UNKNOWN'), edge as (select a.sku_id x, b.sku_id y from ready a join ready b on a.brand_id = b.brand_id and a.unit_value = b.unit_value and a.unit_uom = b.unit_uom and a.form = b.form and a.sku_id <> b.sku_id
    where coalesce(a.gs1 = b.gs1, true) and (len(a.origin) = 0 or len(b.origin) = 0 or list_has_any(a.origin, b.origin)))""", "reach(x, y) as (select sku_id, sku_id from attr union select r.x, e.y from reach r join edge e on e.x = r.y), comp as (select x sku_id, min(y) c from reach group by 1)").replace("with ", "with recursive ", 1))
def q_attribute_groups(spark, d):
    return K.attribute_groups(_attrs(spark, d))


# -- pair features over attribute records

_FLAG = "coalesce({0}, false)::int::double"
_PAIR_SQL = f"""select b.sku_a, b.sku_b, {_FLAG.format("x.form = y.form")} as form_same, {_FLAG.format("x.form <> 'UNKNOWN' and y.form <> 'UNKNOWN'")} as form_both_known,
    round(coalesce(least(x.unit_value, y.unit_value) / nullif(greatest(x.unit_value, y.unit_value), 0) * (x.unit_value is not null and y.unit_value is not null)::int, 0), 6) as unit_ratio, {_FLAG.format("x.unit_uom = y.unit_uom")} as unit_same_uom, {_FLAG.format(O.origins_meet("x", "y"))} as origin_compatible,
    {_FLAG.format("len(x.origin) > 0 and x.origin = y.origin")} as origin_exact_same, {_FLAG.format("x.brand_key <> '' and x.brand_key = y.brand_key")} as brand_same, {_FLAG.format("x.gs1 = y.gs1")} as gs1_same, {_FLAG.format("x.gs1 <> y.gs1")} as gs1_conflict, {_FLAG.format("x.pack_count = y.pack_count")} as pack_count_same,
    {_FLAG.format("substring(b.sku_a, 1, 5) = substring(b.sku_b, 1, 5)")} as same_merchant, round(coalesce(len(list_intersect(gx, gy)) / nullif(len(list_distinct(gx || gy)), 0)::double, 0), 6) as title_2gram_jaccard, round(coalesce(len(list_intersect(rx, ry)) / nullif(len(list_distinct(rx || ry)), 0)::double, 0), 6) as resid_jaccard,
    round(coalesce(ci / nullif(coalesce(sx, 0) + coalesce(sy, 0) - coalesce(ci, 0), 0), 0), 5) as resid_jaccard_idf, round(coalesce(sx, 0) + coalesce(sy, 0) - 2 * coalesce(ci, 0), 4) as sum_idf_in_diff, (c.sku_a is not null)::int::double as variant_conflict, round(case when greatest(length(x.title), length(y.title)) > 0 then least(length(x.title), length(y.title)) / greatest(length(x.title), length(y.title)) else 0 end, 6) as len_ratio
    from {BEST} b join attr x on x.sku_id = b.sku_a join attr y on y.sku_id = b.sku_b join grams g1 on g1.sku_id = b.sku_a join grams g2 on g2.sku_id = b.sku_b left join conflict c on c.sku_a = b.sku_a and c.sku_b = b.sku_b left join shared i on i.sku_a = b.sku_a and i.sku_b = b.sku_b, lateral (select g1.g gx, g2.g gy, g1.r rx, g2.r ry, g1.s sx, g2.s sy) z"""
_GRAM_SQL = f"""weight as (select term, ln(((select count(*) from listed) + 1) / (df + 1)) + 1 w from freq), grams as (select a.sku_id, {GRAMS.format("f")} g, coalesce(r, []) r, s from (select sku_id, {O.fold("title")} f from attr) a left join (select sku_id, list(x.term) r, sum(w) s from term x join weight using (term) group by 1) t on t.sku_id = a.sku_id),
    shared as (select b.sku_a, b.sku_b, sum(w) ci from {BEST} b join term x on x.sku_id = b.sku_a join term y on y.sku_id = b.sku_b and y.term = x.term join weight on weight.term = x.term group by 1, 2)"""


@query(O.select(_PAIR_SQL, O.terms(), O.mined(), O.vetoes(), _CORE, _CONFLICTS, _GRAM_SQL))
def q_pair_features(spark, d):
    attrs, terms, vocab, sigs = _mined(spark, d)
    veto = cut(M.vetoes(terms, vocab, sigs, L.positives(attrs)))
    n = attrs.count()
    profiles = cut(FE.profile(attrs, sigs, M.clean_signatures(sigs, M.veto_terms(veto)), M.idf(M.document_frequency(terms), n)))
    pairs = _best_scores(spark, d).select("sku_a", "sku_b")
    f = FE.pair_features(pairs, profiles, M.variant_conflicts(pairs, sigs, veto), M.veto_terms(veto), n)
    plain = "form_same form_both_known unit_same_uom origin_compatible origin_exact_same brand_same gs1_same gs1_conflict pack_count_same same_merchant variant_conflict".split()
    digits = {"unit_ratio": 6, "title_2gram_jaccard": 6, "resid_jaccard": 6, "resid_jaccard_idf": 5, "sum_idf_in_diff": 4, "len_ratio": 6}
    return f.select("sku_a", "sku_b", *plain, *[F.round(c, k).alias(c) for c, k in digits.items()])


# -- sources and sinks


@query("select row_ord, " + ", ".join(f"nullif(trim({c}, ' '), '') as {c}" for c in io.LISTING_COLUMNS) + " from listings")
def q_read_listings(spark, d):
    return io.read_listings(spark, f"{d}/listings.parquet").select("row_ord", *io.LISTING_COLUMNS)


@query("select distinct least(sku_a, sku_b) as sku_a, greatest(sku_a, sku_b) as sku_b, label, evidence from label_pairs")
def q_read_label_pairs(spark, d):
    return io.read_label_pairs(spark, f"{d}/label_pairs.parquet")


@query("select distinct sku_id, group_id from sku_groups")
def q_read_previous(spark, d):
    return io.read_previous(spark, f"{d}/sku_groups.parquet")


@query("""with want as (select distinct sku_id from listings where sku_id is not null) select * from (select 'repeated' as fault, (select count(*) from (select sku_id from sku_groups group by 1 having count(*) > 1)) as n union all select 'blank', (select count(*) from sku_groups where coalesce(trim(sku_id), '') = '' or coalesce(trim(group_id), '') = '')
    union all select 'missing', (select count(*) from want w where not exists (select 1 from sku_groups g where g.sku_id = w.sku_id)) union all select 'unknown', (select count(*) from sku_groups g where not exists (select 1 from want w where w.sku_id = g.sku_id))) where n > 0""")
def q_mapping_faults(spark, d):
    return io.mapping_faults(table(spark, d, "sku_groups"), table(spark, d, "listings"))


@query("select l.sku_id, l.sku_name_chi, l.brand_name_chi, g.group_id, g.group_name from listings l left join sku_groups g on g.sku_id = l.sku_id")
def q_export_listings(spark, d):
    return io.export_listings(table(spark, d, "listings"), table(spark, d, "sku_groups")).select("sku_id", "sku_name_chi", "brand_name_chi", "group_id", "group_name")


@query("select sku_a, sku_b, case when score is null then '' else printf('%.8f', score) end as score, array_to_string(list_sort(string_split(sources, ';')), ';') as sources, embedding_cosine from candidate_pairs")
def q_score_table(spark, d):
    p = table(spark, d, "candidate_pairs").withColumn("vetoed", F.col("score").isNull()).withColumn("sources", F.split("sources", ";"))
    return io.candidate_scores_table(p)


@query(O.select("""select a.sku_id, g.group_id, s.n as group_name, s.size::int as group_size, a.brand_canonical, a.form as product_form, coalesce(case when a.unit_value is not null then regexp_replace(regexp_replace(a.unit_value::decimal(30, 6)::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || a.unit_uom end, '') as unit, array_to_string(a.origin, '/') as origin, a.pack_count, array_to_string(a.ean_all, ';') as ean, a.title as sku_name, 'v' as method_version, 'f' as dataset_sha256
    from attr a join sku_groups g on g.sku_id = a.sku_id join (select group_id, min(group_name) n, count(*) size from sku_groups group by 1) s on s.group_id = g.group_id"""))
def q_groups_table(spark, d):
    g = table(spark, d, "sku_groups").filter("group_id is not null")
    clusters = g.select("sku_id", F.col("group_id").alias("cluster"))
    ids = g.select(F.col("group_id").alias("cluster"), "group_id").distinct()
    names = g.groupBy(F.col("group_id").alias("cluster")).agg(F.min("group_name").alias("name"))
    return io.groups_table(clusters, ids, names, _attrs(spark, d), "v", "f")


_TOLD = "lower(regexp_replace({0}, '\\s+', '', 'g'))"


@query(f"""with r as (select sku_id, {O.nfkc('sku_name')} t, pack_count::double v, pack_count || '件' e from sku_groups where sku_name is not null), c as (select *, {_TOLD.format('t')} src from r)
    select sku_id, case when contains(src, e) and v between 1 and 100 then v::int end as v_pack, true as v_unit_null from c""")
def q_validated_records(spark, d):
    """What titles support of records that state the earlier run's pack counts."""
    g = table(spark, d, "sku_groups").filter("sku_name is not null")
    told = F.to_json(F.struct(F.struct(F.col("pack_count").cast("double").alias("value"), F.concat(F.col("pack_count").cast("string"), F.lit("件")).alias("evidence")).alias("pack_count")))
    return R.validate(R.parse(g.select("sku_id", F.col("sku_name").alias("text"), told.alias("json")))).select("sku_id", "v_pack", "v_unit_null")


# -- the rest

_LEVELS = {
    "raw": ("t", lambda t: F.col(t)),
    "lower": ("lower(t)", lambda t: F.lower(t)),
    "folded": (FOLD.format("t"), lambda t: T.fold(t)),
    "no_digits": ("regexp_replace(" + FOLD.format("t") + ", '[0-9]+', '', 'g')", lambda t: F.regexp_replace(T.fold(t), "[0-9]+", "")),
    "nfkc": ("n", lambda t: F.col("n")),
    "clean": (FOLD.format(O.clean("n")), lambda t: T.fold(T.clean_title("n"))),
    "packfree": (FOLD.format(O.packfree("n")), lambda t: T.fold(T.packfree("n"))),
}


@query(
    f"with t as (select sku_id, sku_name_chi t, {O.nfkc('sku_name_chi')} n from {FIRST} where sku_name_chi is not null), k as (select sku_id, {', '.join(f'{e} k_{n}' for n, (e, _) in _LEVELS.items())} from t), pos as (select distinct sku_a, sku_b from label_pairs where label = 1) "
    + " union all ".join(f"select '{n}' as level, (select count(distinct k_{n}) from k where k_{n} <> '') as groups, (select count(*) from pos join k x on x.sku_id = sku_a join k y on y.sku_id = sku_b where x.k_{n} = y.k_{n} and x.k_{n} <> '') as pairs_found" for n in _LEVELS)
)
def q_norm_ablation(spark, d):
    rows = cut(_listings(spark, d).select("sku_id", F.col("sku_name_chi").alias("t"), T.nfkc("sku_name_chi").alias("n")).filter("t is not null"))
    return E.normalisation_levels(rows, {n: f("t") for n, (_, f) in _LEVELS.items()}, _labels(spark, d).filter("label = 1"))


@query()
def q_ivf_recall(spark, d):
    e = table(spark, d, "embeddings")
    return V.recall_against_exact(q_ivf_topk(spark, d), V.exact_top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 20))


@query("select true as recall_reached, (select count(*) from embeddings where vec_id % 100 = 0) * 20 as n")
def q_ivf_recall_reached(spark, d):
    """Whether the registered search finds nine in ten of the exact neighbours, by its own result."""
    return q_ivf_recall(spark, d).select((F.col("recall") >= 0.9).alias("recall_reached"), "n")


@query(
    """with h as (select vec_id, list_sum([case when embedding[i + 1] > 0 then (1::hugeint << i) else 0 end for i in range(0, 24)])::bigint b from embeddings)
    select least(x.vec_id, y.vec_id) as a, greatest(x.vec_id, y.vec_id) as b, bit_count(xor(x.b, y.b))::int as distance from h x join h y on x.vec_id < y.vec_id where bit_count(xor(x.b, y.b)) <= 3"""
)
def q_hamming_bands(spark, d):
    """Signs of the first 24 coordinates: short enough that pairs within three bits exist."""
    bits = F.transform(F.slice("embedding", 1, 24), lambda x: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    packed = F.aggregate(F.reverse(bits), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))
    return IM.near_duplicates(table(spark, d, "embeddings").select("vec_id", packed.alias("h")), "vec_id", "h", 3)


@query(O.select("""select * from (select 'one kind' as "check", (select count(*) from (select group_id from g where form <> 'UNKNOWN' group by 1 having count(distinct form) > 1)) as faults union all select 'one base unit', (select count(*) from (select group_id from g where unit_uom is not null group by 1 having count(distinct unit_uom) > 1))
    union all select 'one maker', (select count(*) from (select group_id from g where gs1 is not null group by 1 having count(distinct gs1) > 1))
    union all select 'bars apart from liquids', (select count(*) from (select group_id from g group by 1 having bool_or(form in ('soap_bar', 'laundry_soap', 'shampoo_bar')) and bool_or(form in ('body_wash', 'hand_wash', 'body_lotion'))))
    union all select 'one code, one group', (select count(*) from pos p where not """ + "{0}" + """) union all select 'counts do not divide', (select count(*) from invariant p where not """ + "{0}" + """) union all select 'other codes, other groups', (select count(*) from neg p where """ + "{0}" + """))""", O.terms(), O.mined(), _POS, _NEG, _INVARIANT, "gg as (select sku_id, group_id from sku_groups where group_id is not null), g as (select gg.group_id, a.* from gg join attr a on a.sku_id = gg.sku_id)").replace("{0}", "exists (select 1 from gg x join gg y on x.group_id = y.group_id where x.sku_id = p.sku_a and y.sku_id = p.sku_b)"))
def q_regression_checks(spark, d):
    attrs, _, _, sigs = _mined(spark, d)
    pos = cut(L.positives(attrs))
    groups = table(spark, d, "sku_groups").filter("group_id is not null").select("sku_id", "group_id")
    return E.regression_checks(groups, attrs, pos, L.negatives(attrs, pos), L.pack_invariance(attrs, sigs))


_RUN = ("n_groups", "n_singletons", "max_group", "recall", "merge_rate", "precision", "pack_invariance", "candidate_recall", "n_candidates")


def _pipeline(spark, d, method: str) -> DataFrame:
    """The whole run on all listings: its quality and the seconds of its stages."""
    from samewise.plans.pipeline import Config, run

    out = run(table(spark, d, "listings"), Config(method=method), table(spark, d, "sku_groups").select("sku_id", "group_id").distinct())
    r = out["report"]
    stages = F.create_map(*[F.lit(x) for k, v in r["timings"].items() for x in (k, float(v))])
    return out["metrics"].select(F.lit(method).alias("method"), F.lit(float(r["threshold"])).alias("threshold"), *_RUN, stages.alias("seconds"))


@query()
def q_pipeline_lexical(spark, d):
    return _pipeline(spark, d, "lexical")


@query()
def q_pipeline_local_tfidf(spark, d):
    return _pipeline(spark, d, "local_tfidf")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
