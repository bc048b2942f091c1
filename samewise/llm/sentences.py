"""Sentence boundaries across languages and scripts (problem 9).

1. Blank lines end units, and every list item on its own line is a unit and one sentence.
2. Elsewhere candidates are generated: runs of closing punctuation outside quotations and brackets
   (with the marks that close right after them), and, in scripts that write no such punctuation,
   white space. What a quotation or a bracket holds gives no candidate.
3. A maximum-entropy classifier (logistic regression over hashed features) decides each candidate from
   its neighbouring tokens, their case, length, digits and script, the mark, and what introduced a
   quotation.

The classifier is trained on reliable boundaries of the corpus itself. A unit's end is one, with the
first token of the next prose unit as its right neighbour; a mark that is written for nothing else
(a full stop of Chinese or Hindi outside quotations) is one too. A mark followed by a small letter is
reliably none. All other candidates are unlabelled: they enter as negatives of small weight, so that what never
ends a unit (``Dr.``, ``No.``) and what never begins one loses, and what often does wins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most texts the classifier is fitted on (those with the least hash of the id), and the longest of them in characters.
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 20_000
DIMENSIONS = 1 << 18
UNLABELLED = 0.08

# Closing punctuation, pairs, and scripts without either spaces between words or closing punctuation.
STOPS = ".!?…。！？｡।॥؟۔።"
WIDE_STOPS = "…。！？｡।॥؟۔።"
SURE_STOPS = "。！？｡।॥؟۔។"
PAIRS = dict(zip("«“‘(（[［{【「『《〈〔〝", "»”’)）]］}】」』》〉〕〞", strict=True)) | {"„": "“”", "‚": "‘’", '"': '"'}
CLOSERS = "»”’)）]］}】」』》〉〕〞“\""
UNSPACED = "฀-๿຀-໿ༀ-࿿က-႟ក-៿"

_BLANK = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_LINE = re.compile(r"\r\n|\r|\n")
_ITEM = re.compile(r"[^\S\r\n]*(?:[-*+•‧·▪◦–—]|\(?\d{1,3}[.)、．]|[（(]\d{1,3}[）)]|[①-⑳])[^\S\r\n]+\S|[①-⑳]")
_NUMBERED = re.compile(r"\s*[(（]?\d")
_MARK = re.compile(rf"[{re.escape(STOPS)}]+|[{re.escape(''.join(PAIRS))}{re.escape(CLOSERS)}]|(?<=[{UNSPACED}])\s+(?=\S)|(?<=\S)\s+(?=[{UNSPACED}])")
_WORD_BEFORE = re.compile(r"[^\W_]+(?:[.'’°º][^\W_]+)*[°º]?$")
_WORD_AFTER = re.compile(r"[^\W_]+")
_SMALL = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ](?![A-Z])")
_GLUED = re.compile(r"[a-zß-öø-ÿ]{2}\.[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]")  # a blank is missing
_WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_UNSPACED = re.compile(f"[{UNSPACED}]")


_SOLID = re.compile(r"\S")


def _solid(text: str, start: int, end: int) -> int:
    """Position of the first character of text[start:end] that is no white space, ``end`` if there is none."""
    m = _SOLID.search(text, start, end)
    return m.start() if m else end


def _last(text: str, start: int, end: int) -> int:
    """Position behind the last such character, ``start`` if there is none."""
    while end > start and text[end - 1].isspace():
        end -= 1
    return end


def _lead(text: str, start: int, where: int, last: int) -> str:
    """What leads into a quotation that opens at ``where``: a colon, the sentence's begin, or more of it."""
    before = _last(text, start, where)
    return ":" if before > start and text[before - 1] in ":：" else "^" if before == start or where <= last + 1 else "m"


def units(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is a list item) of the stretches that no sentence crosses, untrimmed."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        block = text[at:end]
        starts = [0, *(x.end() for x in _LINE.finditer(block))]
        marked = [bool(_ITEM.match(block, s)) for s in starts]
        # a wrapped line may begin with a number and a stop; a numbered list begins with its first item
        solid = _solid(block, 0, len(block))
        first = max(k for k, s in enumerate(starts) if s <= solid)
        marked = [x and (marked[first] or not _NUMBERED.match(block, s)) for x, s in zip(marked, starts, strict=True)]
        if any(marked):
            cuts = [s for s, x in zip(starts, marked, strict=True) if x]
            cuts = cuts if marked[0] else [0, *cuts]
            for s, e in zip(cuts, [*cuts[1:], len(block)], strict=True):
                yield at + s, at + e, bool(_ITEM.match(block, s))
        else:
            yield at, end, False
        at = m.end() if m else end


def _script(c: str) -> str:
    if not c:
        return "none"
    if c.isdigit():
        return "digit"
    if _WIDE.match(c):
        return "kana" if "぀" <= c <= "ヿ" else "han"
    if _UNSPACED.match(c):
        return "unspaced"
    if c.isalpha():
        o = ord(c)
        case = "upper" if c.isupper() else "lower" if c.islower() else "caseless"
        return f"{'latin' if o < 0x250 else o >> 8}-{case}"
    return c


def features(left: str, mark: str, closed: str, lead: str, right: str, since: int) -> list[int]:
    """Hashed features of a candidate: text before the mark, the mark, what closed after it, what led into that, text after."""
    kind = mark[:2] if mark[:1] in ".…" else mark[:1]
    w = _WORD_BEFORE.search(left)
    before = w[0] if w else left[-1:]
    shape = re.sub(r"\d+", "0", before.casefold())
    if _UNSPACED.match(left[-1:]):
        before = left[-4:]  # vowel signs are no word characters
    if _WIDE.search(before) or _UNSPACED.search(before):
        lefts = [f"L2={before[-2:]}", f"L3={before[-3:]}", f"L4={before[-4:]}"]
        shape = before[-2:]
    else:
        lefts = [f"L={shape}"]
    bare = right.lstrip("«“‘(（[【「『\"'„¿¡<《")
    opened = right[: len(right) - len(bare)][:1]
    a = _WORD_AFTER.match(bare)
    after = a[0] if a else bare[:1]
    s = _script(bare[:1])
    if s in ("han", "kana", "unspaced"):
        rights = [f"R1={bare[:1]}", f"R2={bare[:2]}", f"R3={bare[:3]}"]
    else:
        rights = [f"R={re.sub(r'[0-9]+', '0', after.casefold())}"]
    size = min(len(before), 6)
    span = 0 if since <= 3 else 1 if since <= 8 else 2 if since <= 20 else 3
    ls = _script(before[-1:])
    names = [
        "bias",
        f"k={kind}",
        f"kc={kind}{closed[:1]}{lead}",
        *lefts,
        *rights,
        f"kr={kind}|{s}|{opened}",
        f"kl={kind}|{ls}|{size}",
        f"lr={ls}|{s}|{kind}",
        f"case={before[:1].isupper()}{size}|{s}|{kind}",
        f"Lr={shape}|{s}",
        f"len={kind}|{span}|{ls}",
        *(f"c{x}|{closed[:1]}{lead}" for x in rights if closed),
    ]
    group = "" if mark else "space "  # white space as a mark shares no evidence with the others
    return [zlib.crc32((group + x).encode()) % DIMENSIONS for x in names]


def candidates(text: str, start: int, end: int) -> list[tuple[int, list]]:
    """(position, [left, mark, closed, lead, right, since]) of the candidates inside text[start:end], its end not included."""
    for quoted in (True, False):
        out, stack, last = [], [], start
        at = start
        while m := _MARK.search(text, at, end):
            token, at = m[0], m.end()
            if token[0] in STOPS or token.isspace():
                depth = len(stack)
                stop, closed, lead = m.end(), "", ""
                if token.isspace():
                    if depth or m.start() == start:
                        continue
                    left, right = text[max(start, m.start() - 24) : m.start()], text[m.end() : m.end() + 24]
                    if left[-1:] in STOPS + CLOSERS and not _UNSPACED.match(left[-1:]):
                        continue
                    out.append((m.start(), [left, "", "", "", right, m.start() - last]))
                    last = m.end()
                    continue
                # marks that close right after the stop, and stops after those
                while stop < end and quoted:
                    c = text[stop]
                    if stack and c in PAIRS[stack[-1][0]]:
                        opener, where = stack.pop()
                        lead = _lead(text, start, where, last)
                        closed += c
                        stop += 1
                    elif closed and c in STOPS:
                        stop += 1
                    else:
                        break
                at = stop
                if stack:
                    continue
                if depth and not closed:
                    continue
                right = _solid(text, stop, end)
                if right == end:
                    break
                spaced = right > stop
                wide = token[-1] in WIDE_STOPS or (closed and closed[-1] in "」』）】》〉") or (token[-1] in "!?" and _WIDE.match(text[stop]))
                glued = token == "." and not closed and _GLUED.match(text, m.start() - 2, end) is not None
                if not spaced and not wide and not glued:
                    continue
                out.append((stop, [text[max(start, m.start() - 24) : m.start()], token, closed, lead, text[right : min(end, right + 24)], m.start() - last]))
                last = stop
            elif quoted:
                if stack and token in PAIRS[stack[-1][0]]:
                    stack.pop()
                elif token in PAIRS and not (token == "‘" and m.start() > start and text[m.start() - 1].isalnum()):
                    stack.append((token, m.start()))
        if not stack:
            break  # else a pair never closes: its mark is read as plain text
    return out


def _ending(text: str, start: int, end: int, found: list) -> list | None:
    """The unit's end as a candidate without right side; None where nothing reliable ends it."""
    end = _last(text, start, end)
    last = found[-1][0] if found else start
    stop = end
    while stop > start and text[stop - 1] in CLOSERS:
        stop -= 1
    mark = stop
    while mark > start and text[mark - 1] in STOPS:
        mark -= 1
    if mark < stop:
        closed = text[stop:end]
        lead = ""
        if closed:
            opener = next((k for k, v in PAIRS.items() if closed[0] in v), "")
            where = text.rfind(opener, start, mark) if opener else -1
            lead = _lead(text, start, where, last) if where >= 0 else "^"
        return [text[max(start, mark - 24) : mark], text[mark:stop], closed, lead, None, mark - last]
    if end > start and _UNSPACED.match(text[end - 1]):
        return [text[max(start, end - 24) : end], "", "", "", None, end - last]
    return None


def examples(text: str) -> Iterator[tuple[list[int], float, float]]:
    """(features, label, weight) of one text's candidates."""
    prose = []
    for s, e, item in units(text):
        if not item and _solid(text, s, e) < e:
            found = candidates(text, s, e)
            prose.append((s, e, found, _ending(text, s, e, found)))
    prose = [p for p in prose if p[3]]
    for k, (_, _, found, ending) in enumerate(prose):
        s, e = prose[(k + 1) % len(prose)][:2]
        right = _solid(text, s, e)
        ending[4] = text[right : min(e, right + 24)]
        yield features(*ending), 1.0, 1.0
        for _, f in found:
            if f[1] and f[1][-1] in SURE_STOPS and not f[2]:
                yield features(*f), 1.0, 1.0
            else:
                yield features(*f), 0.0, 1.0 if _SMALL.match(f[4]) and f[4][:1].islower() and f[1] and f[1][0] in ".!?…" else UNLABELLED


def fit(texts: list[str], epochs: int = 6, seed: int = 3, rate: float = 0.15, decay: float = 1e-6) -> np.ndarray:
    """Weights of the classifier: weighted logistic loss, Adagrad in a fixed order. No texts give weights that cut at every candidate."""
    rows = [x for t in texts for x in examples(t)]
    w = np.zeros(DIMENSIONS, np.float32)
    if not any(y for _, y, _ in rows):
        return w
    width = max(len(f) for f, _, _ in rows)
    x = np.full((len(rows), width), -1, np.int32)
    for i, (f, _, _) in enumerate(rows):
        x[i, : len(f)] = f
    y, weight = np.array([r[1] for r in rows], np.float32), np.array([r[2] for r in rows], np.float32)
    live = x >= 0
    x = np.where(live, x, 0)
    seen = np.full(DIMENSIONS, 1e-2, np.float32)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 256)):
            z = (w[x[part]] * live[part]).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part]
            g = (g[:, None] * live[part]).ravel()
            at = x[part].ravel()
            u, inv = np.unique(at, return_inverse=True)
            step = np.bincount(inv, g, len(u)).astype(np.float32) + decay * w[u]
            seen[u] += step * step
            w[u] -= rate * step / np.sqrt(seen[u])
    return w


def sentences(text: str | None, w: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one text, code points, end exclusive, without surrounding white space."""
    out = []
    if not text:
        return out

    def add(a: int, b: int) -> None:
        a = _solid(text, a, b)
        b = _last(text, a, b)
        if b > a:
            out.append((a, b))

    for s, e, item in units(text):
        begin = s
        if not item:
            for stop, f in candidates(text, s, e):
                if float(w[features(*f)].sum()) >= 0:
                    add(begin, stop)
                    begin = stop
        add(begin, e)
    return out


def model(documents: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """The classifier of a corpus, fitted on at most SAMPLE_DOCS texts of at most SAMPLE_CHARS characters, whatever its size."""
    sample = documents.filter(F.length(text) > 0).filter(F.length(text) <= SAMPLE_CHARS).select(F.col(text).alias("t"), F.xxhash64(key, text).alias("h")).orderBy("h", "t").limit(SAMPLE_DOCS)
    return fit([r.t for r in sample.select("t").collect()])


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """(key, sent_start, sent_end): one row for each sentence of each row. Null, empty and blank texts have none; repeated
    rows are each split. Map-only once the classifier is there; its weights (DIMENSIONS floats) are the only broadcast.
    """
    w = documents.sparkSession.sparkContext.broadcast(model(documents, key, text) if weights is None else weights)

    @F.pandas_udf("array<struct<s: int, e: int>>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"s": a, "e": b} for a, b in sentences(t, w.value)])

    return documents.select(key, F.explode(cut_up(F.col(text))).alias("x")).select(key, F.col("x.s").alias("sent_start"), F.col("x.e").alias("sent_end"))


def p9_found(documents: DataFrame) -> DataFrame:
    return split_sentences(documents, "doc_id", "text")
