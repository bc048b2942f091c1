import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from samewise.llm import mixing, tokens

PIECES = [*"ab 'reslvtdm\n\t.,!?12<|>", "é", "皂", "\u00a0", "😍", "\u0301", "\u200d", "  ", "'re", "<|endoftext|>"]
ALPHABET = st.lists(st.sampled_from(PIECES), max_size=200).map("".join)


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.integers(1, 40))
def test_tree_equals_whole(text, size):
    t = tokens.tokenizer()
    whole = t.encode(text, add_special_tokens=False).ids
    assert tokens.encode_text(t, text, size) == whole
    assert tokens.decode(t, whole) == text


def test_most_texts_are_trees_and_all_trees_of_a_batch_equal_whole_encoding():
    t, r = tokens.tokenizer(), random.Random(8)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 1200))) for _ in range(300)] + ["a" * 5000, " " * 3000, "皂" * 2000, "!" * 1000 + "'re" * 500, None, ""]
    assert sum(bool(x) and len(x) > tokens.LEAF for x in texts) > 200
    assert tokens.encode_all(t, texts) == [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]
    assert tokens.encode_all(t, texts, None) == tokens.encode_all(t, texts, 7)


def test_a_tokenizer_of_another_kind_encodes_whole_texts():
    other = "/opt/tokenizers/word_bpe_49k.json"
    assert tokens.splittable() and not tokens.splittable(other)
    text = "Soap of  roses, isn't it? " * 20
    assert tokens._encode_all(pd.Series([text, None]), other, 16) == [tokens.tokenizer(other).encode(text, add_special_tokens=False).ids, []]


def test_ids_of_edge_texts(spark):
    long = "Soap of 皂  'twas it's 100g! " * 20000
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, long), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.p7_ids(df).collect())
    t = tokens.tokenizer()
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 5]
    assert got[0][1] == got[1][1] == [] and 50256 not in got[3][1]
    assert got[4][1] == got[5][1] == t.encode(long, add_special_tokens=False).ids
    assert tokens.p7_ids(df.limit(0)).count() == 0


def brute(docs, targets, budget, key):
    out = []
    for s, w, reps in targets:
        total = 0
        for p in range(1, reps + 1):
            for d in sorted((x for x in docs if x[1] == s), key=lambda x: (key(x[0], p), x[0])):
                total += d[2]
                if total / w <= budget:
                    out.append((d[0], s, p))
    return sorted(out)


@pytest.mark.parametrize("budget", [None, 500.0, 1e6])
def test_mix_against_brute_force(spark, monkeypatch, budget):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    r = random.Random(5)
    docs = [(i, r.choice("aaab c".split() + ["a", "b", "zz", None]), r.randint(0, 30)) for i in range(200)]
    docs = [(i, s, t) for i, s, t in docs]
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("none", 0.0, 3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    tg = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    keys = {(x.doc_id, x.p): x.k for x in df.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("doc_id", "p", F.xxhash64("doc_id", F.col("p").cast("int"), F.lit(17)).alias("k")).collect()}
    got = mixing.mix(df, tg, budget).collect()
    use = budget if budget is not None else mixing.largest_budget(mixing.capacities(df, tg))
    assert sorted((x.doc_id, x.source, x["pass"]) for x in got) == brute(docs, targets[:3], use, lambda d, p: keys[d, p])
    assert [x.finish for x in got] == sorted(x.finish for x in got)
    rep = {x.source: x for x in mixing.report(df, tg, budget).collect()}
    total = sum(x.tokens for x in got)
    assert sum(x.mixed for x in rep.values()) == total
    if budget is None:
        assert all(x.met for x in rep.values()) and all(abs(rep[s].actual_share - w) < 0.05 for s, w, _ in targets)
    if budget == 1e6:
        assert not rep["a"].met and rep["a"].uses == sum(1 for d in docs if d[1] == "a")


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, tokens long")
    tg = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(df, tg).count() == 0
    assert [x.actual_share for x in mixing.report(df, tg).collect()] == [0.0]


def test_sources_that_give_nothing_do_not_empty_the_mix(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "a", 10), (3, "b", 10), (4, "void", 0), (5, "never", 10)], "doc_id long, source string, tokens long")
    tg = spark.createDataFrame([("a", 0.4, 1), ("b", 0.2, 1), ("void", 0.1, 1), ("none", 0.2, 3), ("never", 0.1, 0)], "source string, target_share double, max_repeats int")
    rep = {x.source: x for x in mixing.report(df, tg).collect()}
    assert {s: x.met for s, x in rep.items()} == {"a": True, "b": True, "void": False, "none": False, "never": False}
    assert {s: x.mixed for s, x in rep.items()} == {"a": 20, "b": 10, "void": 0, "none": 0, "never": 0}


def test_budgets_above_supply_and_mixes_of_nothing_are_reported(spark):
    df = spark.createDataFrame([(i, s, 10) for i, s in enumerate("aaaaaaaabb")] + [(99, "off", 7)], "doc_id long, source string, tokens long")
    tg = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 1), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    budget = mixing.whole_budget(mixing.capacities(df, tg))
    rep = {x.source: x for x in mixing.report(df, tg, budget).collect()}
    assert budget == 100.0 and {s: (x.met, x.short, x.mixed) for s, x in rep.items()} == {"a": (True, 0, 50), "b": (False, 20, 20), "c": (False, 10, 0)}
    assert abs(sum(x.actual_share for x in rep.values()) - 1) < 1e-5
    nothing = mixing.report(df.filter("source = 'off'"), tg).collect()
    assert [x.met for x in nothing] == [False] * 3 and mixing.mix(df.filter("source = 'off'"), tg).count() == 0
