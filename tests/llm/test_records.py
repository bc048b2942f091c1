"""Problems 1 to 5 on small fixtures, with the edge cases of their docstrings."""

import itertools
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from samewise import session
from samewise.llm import brands, components, distinct_terms, normal_form, same_product

REF = [(1, "Pelladel", "潔柏蘭", "韓國"), (2, "Haus Vixyndra", "蔓睿佳", "法國"), (3, "Övrögård", None, "法國"), (4, "Kestumber & Daughters", "瑪米凱薇", "日本"), (5, "麗伊晶絲", "Wexléa", "意大利")]
REF_SCHEMA = "brand_id long, brand_canonical string, brand_alt string, home_country string"
LISTING = "row_ord long, sku_id string, sku_name_chi string, brand_name_chi string, pack_size_chi string, description_chi string"


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame(REF, REF_SCHEMA)


def listing(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LISTING)


ENTRIES = {
    "pELLADEL": 1, "Pelladel™": 1, "Pelladel Co., Ltd.": 1, "洁柏兰": 1, "結柏蘭": 1, "韓國Pelladel": 1, "Pell adel": 1, "Pellaedl": 1, "Pelladel | 潔柏蘭": 1, "Реllаdel": 1,
    "Vixyndra": 2, "H. Vixyndra": 2, "Haus-Vixyndra": 2, "Vixyndra, Haus": 2, "haus vixyndrra": 2, "ovrogård": 3, "ÖVRÖGÅRD": 3, "Övrögård": 3, "Kestumber Dau.": 4, "Daughters & Kestumber": 4, "Wexla": 5, "Wexléa": 5,
    "Haus Alvuxley": 0, "阿滿代購": 0, "???": 0, " ": 0, "N/A": 0, "潔特柏": 0,
}


def test_brands(spark, ref):
    rows = [(f"s{i}", "t", e, None, None) for i, e in enumerate(ENTRIES)] + [("exact", "t", "Pelladel", None, None), ("none", "t", None, None, None), ("empty", "t", "", None, None), ("s0", "t", "pELLADEL", None, None)]
    groups = spark.createDataFrame([("g1", "pelladel", "x"), ("g2", "Pelladel", "x"), ("g3", None, "x"), (None, "pelladel", "x")], "sku_id string, brand_canonical string, brand_id string")
    got = {(r.rec_table, r.sku_id): r.brand_id for r in brands.p1_found(listing(spark, rows), groups, ref).collect()}
    assert got == {("listings", f"s{i}"): b for i, b in enumerate(ENTRIES.values())} | {("sku_groups", "g1"): 1}
    assert brands.p1_found(listing(spark, rows).limit(0), groups.limit(0), ref).count() == 0


def test_token_correction_equals_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(3, 10)))
    vocabulary, tokens = {word() for _ in range(60)}, {word() for _ in range(160)}

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    def near(a, b):
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            if len(d) <= 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]):
                return True
        return levenshtein(a, b) <= (2 if min(len(a), len(b)) >= 8 else 1)

    want = {(t, v) for t in tokens for v in vocabulary if t == v or (t not in vocabulary and len(t) >= 4 and len(v) >= 4 and near(t, v))}
    df = lambda xs, n: spark.createDataFrame([("l", x) for x in xs], f"kind string, {n} string")
    got = {(x.token, x.word) for x in brands.correct_tokens(df(tokens, "token"), df(vocabulary, "word")).collect()}
    assert got == want


def test_brands_with_other_words_two_edits_and_no_caps(spark):
    long = "supercalifragilistic" * 4
    ref = [(1, "Nivea", None, "德國"), (2, "Dove", None, "美國"), (3, "Palmolive", None, "美國"), (4, "Dr. Bronner's", None, "美國"), (5, long, None, None), (6, "Haus Vixyndra", None, "法國")]
    ref += [(100 + i, f"Brand{i:05d}x", None, chr(0x4E00 + i) + chr(0x5E00 + i) + "國") for i in range(1100)]
    ref = spark.createDataFrame(ref, REF_SCHEMA)
    place = chr(0x4E00 + 1099) + chr(0x5E00 + 1099) + "國"
    want = {"Nivea for Men": 1, "Dove Beauty": 2, "Pallmollive Naturals": 3, "Dr Bronner's": 4, "Dr. Bronners": 4, long.replace("gil", "gli", 1): 5, "x" * 5000: 0, f"{place}Nivea": 1, "H a u s Vixyndra": 6, "Haus Meier": 0, "Nievea-Creme": 1}
    got = {r.raw: r.brand_id for r in brands.resolve(spark.createDataFrame([(x,) for x in want], "raw string"), "raw", ref).collect()}
    assert got == want


def test_reading_form():
    f = normal_form.reading_form
    assert f("Ｐ​еllаdel 皂") == "Pelladel 皂" and f("⼿工") == "手工" and f("O­̈v") == "Öv" and f("Рrахороlо") == "Praxopolo"
    assert f("мыло") == "мыло" and f("σαπούνι") == "σαπούνι" and f(None) is None and f(" 　") == ""
    assert f("Case") != f("case") and f("é") != f("e") and f("洁") != f("潔")
    assert normal_form.PLAIN.consistent("Сοаp") == "Coap"


def test_whole_table_of_look_alikes(spark):
    table = normal_form.look_alikes(spark)
    f = lambda x: normal_form.reading_form(x, table)
    assert f("Rոse") == f("Rnse") and f("Ꭰove") == "Dove" and f("sⲟap") == "soap" and f("ɡold") == "gold" and f("sσap") == "soap" and f("ѵita") == "vita" and f("τea") == f("тea")
    assert f("мыло") == "мыло" and f("S0ap") != f("SOap") and f("lI1") == "lI1" and f("Soap") != f("soap") and f("é") != f("e") and f("ไทย") == "ไทย" and f("香皂") == "香皂"
    assert all(f(f(x)) == f(x) for x in table.shape)


def test_no_table_of_look_alikes_is_an_error(spark, ref, monkeypatch):
    rows = listing(spark, [("a", "Rose", "Dove", None, None), ("b", "Rоse", "Ꭰove", None, None)])
    monkeypatch.setattr(normal_form, "_WHOLE", [])
    monkeypatch.setattr(type(spark.sparkContext), "_jvm", None)  # as without ICU: nothing can be asked for skeletons
    monkeypatch.setattr(normal_form.SparkSession, "active", lambda: spark)
    for make in (lambda: normal_form.look_alikes(spark), lambda: normal_form.reading_form_column("sku_name_chi"), lambda: distinct_terms.terms(rows, "sku_id", "sku_name_chi")):
        with pytest.raises(RuntimeError, match="look-alikes needs"):
            make()


def test_whole_table_in_any_thread(spark, ref, monkeypatch):
    rows = listing(spark, [("a", "Dove", "Pelladel", None, None), ("b", "Ꭰove", "Pelladel", None, None)])
    monkeypatch.setattr(normal_form, "_WHOLE", [])
    monkeypatch.setattr(normal_form.SparkSession, "getActiveSession", lambda: None)  # as in a thread that has none
    assert [tuple(r) for r in normal_form.p2_found(rows, ref).collect()] == [("sku_name_chi", "a", "b")]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_reading_form_is_idempotent(text):
    once = normal_form.reading_form(text)
    assert normal_form.reading_form(once) == once


def test_look_alikes(spark, ref):
    rows = [("a", "Soap 90g", "Pelladel", None, None), ("b", "Ѕoap 90g", "Реlladel", None, None), ("c", "Soap 90g", "潔柏蘭", None, None), ("d", "Soap　90g", "pelladel", None, None), ("a", "Soap 90g", "Pelladel", None, None), ("e", None, None, None, None), ("f", "", "", None, None), ("g", "​", " ", None, None), ("h", "Other", "Wexléa", None, None)]
    got = {tuple(r) for r in normal_form.p2_found(listing(spark, rows), ref).collect()}
    assert got == {("sku_name_chi", "a", "b"), ("sku_name_chi", "b", "c"), ("sku_name_chi", "a", "d"), ("sku_name_chi", "b", "d"), ("sku_name_chi", "c", "d"), ("brand_name_chi", "1", "b"), ("brand_name_chi", "5", "h")}
    assert normal_form.p2_found(listing(spark, rows).limit(0), ref).count() == 0


def brute_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    r = random.Random(9)
    name = lambda i: f"k{i:03d}"
    pairs = {
        "random": [(name(r.randint(0, 150)), name(r.randint(0, 150))) for _ in range(110)] + [("k001", None), (None, "k002"), ("k200", "k200"), ("k003", "k004"), ("k004", "k003")],
        "chain": [(name((i * 37) % 101), name((i * 37 + 37) % 101)) for i in range(100)],
        "star": [(name(150), name(i)) for i in range(120)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame(pairs, "sku_a string, sku_b string")
    assert {tuple(x) for x in components.components(df, "sku_a", "sku_b").collect()} == brute_components(pairs)


def test_matches_need_a_score(spark):
    df = spark.createDataFrame([("a", "b", 0.5, "x"), ("b", "c", 0.49, "x"), ("c", "d", None, "x"), ("a", "b", 0.1, "x")], "sku_a string, sku_b string, score double, sku_id string")
    assert {tuple(r) for r in components.p3_found(df).collect()} == {("a", "a"), ("b", "a")}


TERMS = {"latin": lambda x: [t for t in (w.lower() for w in re.findall("[A-Za-zÀ-ÖØ-öø-ſ0-9]+", x)) if len(t) >= 4 and not re.search(r"\d", t)], "all": lambda x: [g for w in re.findall("[A-Za-zÀ-ÖØ-öø-ſ0-9]+|[一-鿿]+|[ก-๙]+", x) for g in ([w[i : i + 2] for i in range(len(w) - 1)] if w[0] >= "一" and len(w) > 2 else [w.lower()])]}


@pytest.mark.parametrize("kind", list(TERMS))
def test_distinctive_terms(spark, kind):
    titles = {"a": "Natural Paferosu soap Natural", "b": "Ѕоар Paferosu soap90 Natural", "c": "natural soaps", "d": None, "e": "", "f": "手工香皂 abc 1234", "g": "Natural Natural Élan 香皂", "h": "手工香皂 " * 3000}
    df = listing(spark, [(k, v, None, None, None) for k, v in titles.items()] + [("a", titles["a"], None, None, None)])
    docs = {k: TERMS[kind](normal_form.reading_form(v)) for k, v in titles.items() if v}
    everything = [t for d in docs.values() for t in d]
    want, strength = {}, 1000.0
    for k, d in docs.items():
        for t in set(d):
            y, n, c, total = d.count(t), len(d), everything.count(t), len(everything)
            p = strength * c / total
            rest, others = c - y, total - n
            delta = math.log((y + p) / (n + strength - y - p)) - math.log((rest + p) / (others + strength - rest - p))
            want[k, t] = (sum(t in x for x in docs.values()), round(delta / math.sqrt(1 / (y + p) + 1 / (rest + p)), 6))
    got = {(r.sku_id, r.term): (r.records, r.z) for r in distinct_terms.p4_scores(df, distinct_terms.latin_words if kind == "latin" else distinct_terms.all_terms).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
    if kind == "latin":
        assert {tuple(r) for r in distinct_terms.p4_found(df).collect()} == {(k, t) for (k, t), (n, _) in want.items() if 2 <= n <= 4}
    assert distinct_terms.p4_found(df.limit(0)).count() == 0


UNITS = [("g", "g", 1.0), ("kg", "g", 1000.0), ("oz", "g", 28.3495), ("ml", "ml", 1.0), ("lb", "g", 453.592)]


def catalogue(size=2400, seed=5):
    """Listings of invented products and their product; wordings, orders, advertising and what is left out are drawn."""
    r = random.Random(seed)
    scents = ["檀香 檀木 sandalwood", "桂花 木犀花 osmanthus", "薄荷 胡椒薄荷 peppermint", "抹茶 茶粉 matcha"]
    kinds = ["香皂 番梘 soap", "沐浴露 沐浴乳 shower gel", "浴鹽 泡澡鹽 bath salt"]
    wordings = lambda x: [x.split()[0], x.split()[1], " ".join(x.split()[2:])]
    lines = ["".join(r.sample("暖舟弦霧鹿桃溪泉鶴楓緞螢嵐珊瑚蘆葦", n)) for n in (2, 3, 4, 5) for _ in range(12)] + ["春花秋月", "夏花秋月"]
    stock = [(r.choice(REF[:3]), line, s, k, q) for line in lines for s in r.sample(range(4), 2) for k in r.sample(range(3), 2) for q in r.sample([50, 90, 110, 250], 1)]
    # the same in another brand's name
    stock += [(REF[3], *x[1:]) for x in stock[:12] if x[0] != REF[3]]
    rows = []
    for i in range(size):
        p = r.randrange(len(stock))
        brand, line, s, k, q = stock[p]
        amount = r.choice([f"{q}g", f"{q}克", f"{q / 1000}kg"])
        parts = [line + r.choice(["系列", "之選", ""]), r.choice(wordings(scents[s])), r.choice(wordings(kinds[k])), *r.sample("現貨 限時優惠 保濕 清爽 天然 手工 HOT NEW".split(), 3)]
        gone = r.random()
        if p < 12 or p >= len(stock) - 12 or gone > 0.3:
            parts.append(brand[1])
        if gone > 0.2:
            parts.append(amount)
        r.shuffle(parts)
        told = f"{brand[1]}{line}{r.choice(wordings(scents[s]))}{r.choice(wordings(kinds[k]))},{amount}。" + r.choice(["置於乾爽處。", "開封後盡快用完。", "寄出前檢查外盒。"])
        rows.append((f"m{i:05d}_S_x", " ".join(parts), brand[1] if r.random() > 0.3 else None, None, told if r.random() > 0.2 else None, p))
    return rows


def test_same_product_is_learned_from_the_corpus(spark, ref):
    units = spark.createDataFrame(UNITS, "unit_code string, base_uom string, factor double")
    rows = catalogue()
    truth = {x[0]: x[5] for x in rows}
    got = {(r.sku_a, r.sku_b) for r in same_product.p5_found(listing(spark, [x[:5] for x in rows]), ref, units).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b]}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.97 * len(got)
    # where only the brand differs there is no pair
    brand = {x[0]: x[5] for x in rows}
    last = max(truth.values()) + 1 - 12
    assert not [x for x in got if {brand[x[0]] < 12, brand[x[1]] >= last} == {True} and brand[x[0]] == brand[x[1]] - last]


def test_same_product_edges(spark, ref):
    units = spark.createDataFrame(UNITS, "unit_code string, base_uom string, factor double")
    rows = [
        ("a_S_1", "Pelladel 暖舟弦 檀香 香皂 90g", "Pelladel", None, None),
        ("b_S_1", "香皂 暖舟弦 檀香 潔柏蘭 90克", None, None, None),
        ("c_S_1", "Övrögård 暖舟弦 檀香 香皂 90g", None, None, None),
        ("d_S_1", "Pelladel 暖舟弦 檀香 香皂 200g", None, None, None),
        ("e_S_1", "Pelladel 暖舟弦 玫瑰 香皂 90g", None, None, None),
        ("f_S_1", None, None, None, None),
        ("g_S_1", "", "", "", ""),
        ("h_S_1", "皂 " * 20000, None, None, "香" * 20000),
        ("a_S_1", "Pelladel 暖舟弦 檀香 香皂 90g", "Pelladel", None, None),
        (None, "Pelladel 暖舟弦 檀香 香皂 90g", "Pelladel", None, None),
    ]
    got = {tuple(r) for r in same_product.p5_found(listing(spark, rows), ref, units).collect()}
    assert got == {("a_S_1", "b_S_1")}
    assert same_product.p5_found(listing(spark, rows).limit(0), ref, units).count() == 0


def test_same_product_reads_each_text_once(spark, ref, monkeypatch):
    units = spark.createDataFrame(UNITS, "unit_code string, base_uom string, factor double")
    rows = [("a_S_1", "Pelladel 暖舟弦 檀香 香皂 90g", "Pelladel", "90 g", "暖舟弦香皂"), ("b_S_1", "潔柏蘭 暖舟弦 檀香 香皂 90克", None, None, None)]
    plans, cut = [], same_product.cut
    monkeypatch.setattr(same_product, "cut", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or cut(df))
    assert [tuple(r) for r in same_product.p5_found(listing(spark, rows), ref, units).collect()] == [("a_S_1", "b_S_1")]
    # of all tables that are written one only is read from the listings' texts
    assert sum("sku_name_chi" in p for p in plans) == 1 and sum("description_chi" in p for p in plans) == 1


def test_content_of_unfolded_pack(spark, ref):
    units = spark.createDataFrame(UNITS, "unit_code string, base_uom string, factor double")
    rows = listing(spark, [("a", "香皂", None, "共  ９０　ｇ", None), ("b", "香皂", None, None, "每件\u200b90g"), ("c", "香皂 9０g", None, "1g", None)])
    read = same_product.read_listings(rows, same_product.brand_names(ref), units)
    assert {(r.sku_id, r.uom, r.qty) for r in read.collect()} == {(k, "g", 90.0) for k in "abc"}


def test_segmentation():
    counts = {"手工": 90, "皂紙": 40, "手工皂": 80, "檸檬草": 20, "冷製": 50, "手工皂紙": 5, "肥皂": 70}
    cut_up = lambda run: same_product.segment(run, {w: n for w, n in counts.items() if w in run} | {"系列": 50}, {"系列": 50}, 1000)
    assert cut_up("手工皂紙") == ["手工", "皂紙"] and cut_up("冷製檸檬草肥皂") == ["冷製", "檸檬草", "肥皂"]
    assert cut_up("春花秋月系列") == ["春花秋月", "系列"] and cut_up("夏花秋月系列") == ["夏花秋月", "系列"]


def test_nothing_else_imports_this_folder():
    import pathlib

    root = pathlib.Path(normal_form.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"samewise\.llm|from \.+llm", p.read_text())]


def test_parts_of_runs_stay_off_the_driver(spark):
    runs = session.cut(spark.createDataFrame([("手工皂紙", 5), ("手工", 9), ("皂紙", 7)], "run string, n bigint"))  # a table, of which Spark knows the size
    units = same_product.segmented(runs, {}, 100)
    assert {tuple(r.units) for r in units.collect()} == {("手工", "皂紙")}
    assert "SortMergeJoin [part" in units._jdf.queryExecution().sparkPlan().toString()


def test_release_hands_native_memory_back(spark):
    assert "Trim native heap" in session.trim(spark)
    session.release(spark)
