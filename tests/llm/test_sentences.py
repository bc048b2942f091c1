import time

import numpy as np
import pytest

from samewise.llm import sentences as S

ENGLISH = ["I paid $2.50 for it.", "Dr. Rusk sells it at 5 p.m. daily.", "It smells of lime, tea, etc. and lasts.", "Good value!", "Is No. 4 the same?", "He asked \"is it new? Really.\" and left.", "(Tested on 4 volunteers.)"]
CHINESE = ["好用！", "客服說：「已經寄出。請留意。」但未收到。", "用了10天，很好……", "售價$9.5，很平。", "Dr. Rusk系列很好。"]
THAI = ["ใช้ดีมากค่ะ", "ร้านส่งเร็ว จะซื้ออีกครับ", "ขนาด 90g ราคา 9 บาท คุ้มมากครับ"]


@pytest.fixture(scope="module")
def weights():
    r = np.random.default_rng(1)
    docs = []
    for k in range(600):
        pool, glue = [(ENGLISH, " "), (CHINESE, ""), (THAI, " ")][k % 3]
        docs.append("\n\n".join(glue.join(pool[i] for i in r.integers(0, len(pool), r.integers(1, 4))) for _ in range(3)))
    return S.fit(docs)


@pytest.mark.parametrize(("pool", "glue"), [(ENGLISH, " "), (CHINESE, ""), (THAI, " ")])
def test_known_sentences(weights, pool, glue):
    text = glue.join([*pool, *reversed(pool)])
    assert [text[a:b] for a, b in S.sentences(text, weights)] == [*pool, *reversed(pool)]


def test_blank_lines_items_and_wraps(weights):
    text = "Care guide\r\n\r\n1. Keep dry\r\n2. Net wt. 5 oz.\r\n \r\nGood\nvalue! Good value!\n\n\n"
    assert [text[a:b] for a, b in S.sentences(text, weights)] == ["Care guide", "1. Keep dry", "2. Net wt. 5 oz.", "Good\nvalue!", "Good value!"]


def test_edge_texts(spark, weights):
    rows = [(1, None), (2, ""), (3, " \n\n\t"), (4, "No stop"), (5, "\"Never closed. Good value! "), (6, "好用！" * 30000), (6, "好用！")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = [tuple(r) for r in S.split_sentences(df, weights=weights).collect()]
    by = {k: sum(1 for g in got if g[0] == k) for k in range(1, 7)}
    assert by == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 30001}
    assert S.split_sentences(df.limit(0)).count() == 0


def test_time_grows_with_the_length_only(weights):
    def took(n):
        began = time.process_time()
        S.sentences("He said \"yes. No\" and left. Good value! 好用！(Dr. Rusk) " * n, weights)
        return time.process_time() - began

    took(100)
    short, long = min(took(2000) for _ in range(3)), took(8000)
    assert long < 5 * short + 0.05


def test_long_runs_of_marks_and_blanks(weights):
    for text in ("." * 200_000, "(" * 50_000 + "x.", " " * 200_000 + "x", "\n" * 100_000, "«" * 3000 + "a. B" + "»" * 3000):
        S.sentences(text, weights)


def test_spans_are_trimmed_ordered_and_cover_all_ink(weights):
    text = "  A b.  C d!\n\n* x\n* y  \n\nท่าน ค่ะ "
    spans = S.sentences(text, weights)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
