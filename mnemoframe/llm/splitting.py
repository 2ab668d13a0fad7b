"""Splitting oversized items at natural boundaries.

Balanced targets: the least number of pieces is computed from both limits, their overlaps counted, equal-length targets are placed, each is snapped
to the strongest boundary near it that keeps the limits, and what is left is balanced again, in a piece more where it has to be.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.words import CJK

MAX_TOKENS, MAX_CHARS, OVERLAP = 160, 1200, 20
#: A token is one CJK character or a maximal run of other characters that are not space, tab, CR or LF.
_TOKEN = re.compile(f"[{CJK}]|[^ \\t\\r\\n{CJK}]+")
#: Strength of the boundary before a token, by what ends the token before and what stands between them.
_PARAGRAPH, _HEADING, _LINE, _SENTENCE, _CLAUSE, _SPACE, _INSIDE = 6, 7, 5, 4, 3, 2, 1
_SENTENCE_END = frozenset(".!?…。！？")
_CLAUSE_END = frozenset(",;:，；：、)]}")


def token_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    spans = [m.span() for m in _TOKEN.finditer(text)]
    at = np.array(spans, dtype=np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def _strengths(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of a cut before each token; index 0 is unused."""
    out = np.full(len(starts), _SPACE, dtype=np.int8)
    for i in range(1, len(starts)):
        gap, last = text[ends[i - 1] : starts[i]], text[ends[i - 1] - 1]
        lines = gap.count("\n") or gap.count("\r")
        if lines:
            out[i] = _HEADING if text[starts[i]] == "#" else _PARAGRAPH if lines > 1 else _LINE
        elif last in _SENTENCE_END:
            out[i] = _SENTENCE
        elif last in _CLAUSE_END:
            out[i] = _CLAUSE
        elif not gap:
            out[i] = _INSIDE
    return out


def _units(text: str, starts: np.ndarray, ends: np.ndarray, max_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, those longer than half the character limit cut into parts, so that cuts exist everywhere; a part counts as a token."""
    part = max(1, max_chars // 2)
    if not len(starts) or (ends - starts).max() <= part:
        return starts, ends
    s, e = [], []
    for a, b in zip(starts.tolist(), ends.tolist()):
        n = -(-(b - a) // part)
        cuts = [a + (b - a) * k // n for k in range(n + 1)]
        s += cuts[:-1]
        e += cuts[1:]
    return np.array(s), np.array(e)


def _overlap_starts(starts: np.ndarray, ends: np.ndarray, max_chars: int, overlap: int) -> np.ndarray:
    """For a piece that is new from each token on, the token with which its overlap begins: overlap tokens before, fewer only where those take more than half the limit on characters."""
    at = np.arange(len(starts))
    half = np.searchsorted(starts, ends[np.maximum(at - 1, 0)] - max_chars // 2)
    whole = np.searchsorted(starts, ends - max_chars)  # with the token itself, and white space between
    return np.maximum(np.maximum(at - overlap, 0), np.maximum(half, whole)).clip(max=at)


def split_spans(text: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens of overlap) of each piece in text; one span over everything if, and only if, the text is within both limits.

    Every piece has at most max_tokens tokens and max_chars characters. Pieces after the first begin with overlap tokens of the one before, fewer only
    where those tokens take more than half the limit on characters or the piece before has fewer. Text between pieces is white space only. A
    token over half the limit on characters is cut inside, its parts counting as tokens. Time grows in proportion to the text.
    """
    starts, ends = token_spans(text)
    if len(starts) <= max_tokens and len(text) <= max_chars:
        return [(0, len(text), 0)]
    if not len(starts):
        return [(a, min(a + max_chars, len(text)), 0) for a in range(0, len(text), max_chars)]
    starts, ends = _units(text, starts, ends, max_chars)
    n, strength, overlap = len(starts), _strengths(text, starts, ends), min(overlap, max_tokens - 1)
    begins = _overlap_starts(starts, ends, max_chars, overlap)
    # the token before which a piece that is new from each token on must end, its overlap counted
    by_chars = np.searchsorted(ends, starts[begins] + max_chars, side="right")
    bound = np.maximum(np.minimum(begins + max_tokens, np.where(by_chars < n, by_chars, n + max_tokens)), np.arange(n) + 1)
    furthest = np.minimum(bound, n)
    # how much of a piece each token takes: targets of equal load are of equal length under whichever limit holds there
    load = np.concatenate([[0.0], np.cumsum(1.0 / (bound - np.arange(n)))])

    def snapped(target: float, slack: float, lo: int, hi: int) -> int:
        """The strongest boundary from lo to hi near the target, the nearest of the strongest."""
        a = min(max(int(np.searchsorted(load, target - slack)), lo), hi)
        b = min(max(int(np.searchsorted(load, target + slack, side="right")) - 1, a), hi)
        near = strength[a : b + 1]
        best = np.flatnonzero(near == near.max()) + a
        return int(best[np.abs(load[best] - target).argmin()])

    done, at = [], 0
    while at < n:
        cut = n
        if furthest[at] < n:
            # equal shares of what is left, in as few pieces as its load allows; a cut that was drawn back may add one
            step = (load[-1] - load[at]) / max(2, math.ceil(load[-1] - load[at] - 1e-9))
            cut = snapped(load[at] + step, step / 4, at + 1, min(int(furthest[at]), n - 1))
        done.append((at, cut))
        at = cut
    spans, before = [], 0
    for a, b in done:
        first = max(int(begins[a]), before)
        spans.append((int(starts[first]), int(ends[b - 1]), a - first))
        before = first
    return spans


def split_items(items: DataFrame, id_col: str, text_col: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, piece_index, n_pieces, content, token_count, overlap_tokens, oversized) of every id, pieces in order from 0.

    Copies of an id count once (of differing rows the least text holds); null ids are dropped. Blank items give one empty piece with no
    tokens unless they are over the limit on characters; items within the limits give one piece, their text as it is. Whole texts are
    read, however long. oversized says that the item had to be cut, be it of white space around it, which no piece keeps. The columns of keep
    come along.
    """
    once = items.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(text_col).alias("text"), *keep)).alias("r")).select("id", *[f"r.{c}" for c in keep], "r.text")
    names = ["piece_index", "n_pieces", "content", "token_count", "overlap_tokens", "oversized"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, at = [], []
            for row, text in enumerate(batch["text"]):
                text = text or ""
                spans = split_spans(text, max_tokens, max_chars, overlap)
                cut = spans != [(0, len(text), 0)]
                at += [row] * len(spans)
                for i, (a, b, back) in enumerate(spans):
                    piece = text[a:b] if cut or text.strip() else ""
                    rows.append((i, len(spans), piece, len(_TOKEN.findall(piece)), back, cut))
            yield pd.concat([batch[["id", *keep]].iloc[at].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    kinds = dict(once.dtypes)
    held = ", ".join(f"`{c}` {kinds[c]}" for c in ("id", *keep))
    return once.mapInPandas(run, f"{held}, piece_index int, n_pieces int, content string, token_count int, overlap_tokens int, oversized boolean")
