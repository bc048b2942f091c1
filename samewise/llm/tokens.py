"""Encoding of a whole corpus with a public tokenizer (problem 7), by a monoid tree reduction.

A text is cut into halves down to leaves, leaves are encoded, and neighbours are joined up the tree:

* an element holds the token ids of a span by *word* (the tokenizer's pre-tokens) and the words' starts;
* joining re-encodes a window around the cut. It begins at the last word of the left whose
  end no later text can change: words are matched from left to right, a match looks at most one
  character beyond its end, and a contraction (``'re``) at three characters, so a word that ends more than
  ``REACH`` characters before the cut is final, and so is the next word's start;
* on the right the window grows until one of its own final words begins where a word of the right half
  begins: from the same start the same text is matched the same way, so all later words stand.

Merges never cross words, so the ids of the parts concatenate to the ids of the whole; decoding
concatenates as well. All trees of a batch grow together: their leaves, and the windows of one level, are encoded in one call.
``REACH`` holds for the byte-level pre-tokenizer without a normaliser; a tokenizer of another kind encodes each text as one leaf.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of a leaf: most texts of a paragraph and more are trees.
LEAF = 256
#: Spans encoded at once: their encodings are held side by side.
BATCH = 512
#: Characters before an end of text within which a word may still change: a contraction's three and one of look-ahead.
REACH = 4


@functools.lru_cache(maxsize=4)
def tokenizer(path: str = TOKENIZER):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def splittable(path: str = TOKENIZER) -> bool:
    """Whether REACH holds: byte-level words by the pattern, no normaliser that rewrites the text before."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    words = kind.get("pre_tokenizer") or {}
    return not kind.get("normalizer") and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")


_splittable = functools.lru_cache(maxsize=4)(splittable)


@dataclass
class Span:
    """An encoded span: text[start:end], the starts of its words, their ids, and where each word's ids begin."""

    start: int
    end: int
    starts: list[int]
    ids: list[int]
    first: list[int]


def _span(got, start: int, end: int) -> Span:
    starts, first, last = [], [], None
    for k, (word, at) in enumerate(zip(got.word_ids, got.offsets, strict=True)):
        if word != last:
            starts.append(start + at[0])
            first.append(k)
            last = word
    return Span(start, end, starts, list(got.ids), first)


def spans(encoder, parts: list[tuple[str, int, int]]) -> list[Span]:
    """Encoded spans of (text, start, end), BATCH at a time."""
    out = []
    for s in range(0, len(parts), BATCH):
        some = parts[s : s + BATCH]
        got = encoder.encode_batch([t[a:b] for t, a, b in some], add_special_tokens=False)
        out += [_span(g, a, b) for g, (_, a, b) in zip(got, some, strict=True)]
    return out


def _begin(left: Span) -> int:
    """Number of the left's first word whose end, the next one's start, is not final."""
    return max(0, bisect.bisect_left(left.starts, left.end - REACH) - 1)


def _merge(left: Span, right: Span, window: Span) -> Span | None:
    """The span of both, if a final word of the window begins where one of the right does, or the window holds all of the right."""
    w = _begin(left)
    at = 0
    for meet, s in enumerate(window.starts):
        if s >= right.start:
            at = bisect.bisect_left(right.starts, s, at)
            # a word of the window is final where it ends REACH before the window's end
            if s <= window.end - REACH and at < len(right.starts) and right.starts[at] == s:
                mid, tail = meet, at
                break
    else:
        if window.end < right.end:
            return None
        mid, tail = len(window.starts), len(right.starts)
    mid_ids = window.ids[: window.first[mid]] if mid < len(window.first) else window.ids
    head = left.first[w] if w < len(left.first) else len(left.ids)
    skip = right.first[tail] if tail < len(right.first) else len(right.ids)
    shift = head + len(mid_ids)
    return Span(left.start, right.end, left.starts[:w] + window.starts[:mid] + right.starts[tail:], left.ids[:head] + mid_ids + right.ids[skip:], left.first[:w] + [head + x for x in window.first[:mid]] + [shift + x - skip for x in right.first[tail:]])


def join(encoder, pairs: list[tuple[str, Span, Span]]) -> list[Span]:
    """The spans of all pairs of neighbours; each text reaches at least from its left's start to its right's end."""
    out: list[Span | None] = [None] * len(pairs)
    for k, (_, left, right) in enumerate(pairs):
        if not left.starts or not right.starts:
            full = right if not left.starts else left
            out[k] = Span(left.start, right.end, full.starts, full.ids, full.first)
    reach = 32
    while wait := [k for k, x in enumerate(out) if x is None]:
        windows = spans(encoder, [(pairs[k][0], pairs[k][1].starts[_begin(pairs[k][1])], min(pairs[k][2].end, pairs[k][2].start + reach)) for k in wait])
        for k, window in zip(wait, windows, strict=True):
            out[k] = _merge(pairs[k][1], pairs[k][2], window)
        reach *= 2
    return out


def _halves(start: int, end: int, size: int) -> list[tuple[int, int]]:
    if end - start <= size:
        return [(start, end)]
    mid = (start + end) // 2
    return _halves(start, mid, size) + _halves(mid, end, size)


def encode_all(encoder, texts: list[str | None], size: int | None = LEAF) -> list[list[int]]:
    """Token ids of each text; an empty and a null text have none. Without ``size`` each text is one leaf."""
    out: list[list[int]] = [[] for _ in texts]
    alone = [i for i, t in enumerate(texts) if t and (size is None or len(t) <= size)]
    fast = getattr(encoder, "encode_batch_fast", encoder.encode_batch)  # without offsets, which only joins need
    for s in range(0, len(alone), BATCH):
        part = alone[s : s + BATCH]
        for i, got in zip(part, fast([texts[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = got.ids
    trees = [i for i, t in enumerate(texts) if t and size is not None and len(t) > size]
    for s in range(0, len(trees), BATCH):
        part = trees[s : s + BATCH]
        leaves = [(i, a, b) for i in part for a, b in _halves(0, len(texts[i]), size)]
        rows: dict[int, list[Span]] = {i: [] for i in part}
        for (i, _, _), x in zip(leaves, spans(encoder, [(texts[i], a, b) for i, a, b in leaves]), strict=True):
            rows[i].append(x)
        while any(len(r) > 1 for r in rows.values()):
            pairs = [(i, k) for i, r in rows.items() for k in range(0, len(r) - 1, 2)]
            joined = iter(join(encoder, [(texts[i], rows[i][k], rows[i][k + 1]) for i, k in pairs]))
            rows = {i: [next(joined) if k + 1 < len(r) else r[k] for k in range(0, len(r), 2)] for i, r in rows.items()}
        for i, r in rows.items():
            out[i] = r[0].ids
    return out


def encode_text(encoder, text: str | None, size: int | None = LEAF) -> list[int]:
    return encode_all(encoder, [text], size)[0]


def _encode_all(texts: pd.Series, path: str, size: int | None) -> list[list[int]]:
    return encode_all(tokenizer(path), [t if t else None for t in texts], size if _splittable(path) else None)


def token_ids(column: Column | str, path: str = TOKENIZER, size: int = LEAF) -> Column:
    """array<int> of a text column. Map-only; the vocabulary is read by each worker from ``path``, never broadcast."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(_encode_all(texts, path, size))

    return ids(F.col(column) if isinstance(column, str) else column)


def token_count(column: Column | str, path: str = TOKENIZER, size: int | None = None) -> Column:
    """Number of tokens of a text column, 0 for null and empty. Counts need no trees: without ``size`` each text is one leaf."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in _encode_all(texts, path, size)])

    return count(F.col(column) if isinstance(column, str) else column)


def decode(encoder, ids: list[int]) -> str:
    """Decoding concatenates up the tree: the bytes of the parts are the bytes of the whole."""
    return encoder.decode(ids, skip_special_tokens=False)


def p7_ids(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids): one row for each row of documents; null and empty texts have an empty list."""
    return documents.select("doc_id", token_ids("text", path).alias("ids"))
