"""Evaluation texts leaking into training text.

Wu-Manber search over words: patterns are the windows of 12 words of every item. Blocks of two words index a shift table that says how far
the search may jump; where it says 0 the hash of the window's end picks the windows to compare with, word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm.words import words

WINDOW = 12
#: Items searched for at a time: their tables are what a task holds, so any number of items is done in blocks of so many.
ITEMS_PER_BLOCK = 20_000
#: Words of the items of one block, however few items they are.
WORDS_PER_BLOCK = 2_000_000


class WuManber:
    """Search of word windows of one length; find(words) gives the ids of the items of which a window occurs."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW) -> None:
        self.window = window
        self.owners: dict[tuple[str, ...], set[int]] = {}
        for key, text in items:
            for i in range(len(text) - window + 1):
                self.owners.setdefault(tuple(text[i : i + window]), set()).add(key)
        self.shift: dict[tuple[str, str], int] = {}
        self.ending: dict[tuple[str, str], dict[int, list[tuple[str, ...]]]] = {}
        for pattern in self.owners:
            for j in range(1, window):
                block = pattern[j - 1 : j + 1]
                self.shift[block] = min(self.shift.get(block, window), window - 1 - j)
            self.ending.setdefault(pattern[-2:], {}).setdefault(hash(pattern[:2]), []).append(pattern)

    def find(self, text: list[str]) -> set[int]:
        window, shift, n, out = self.window, self.shift.get, len(text), set()
        if not self.owners:
            return out
        far, end = window - 1, window - 1
        while end < n:
            jump = shift((text[end - 1], text[end]), far)
            if jump:
                end += jump
                continue
            start = end - window + 1
            for pattern in self.ending[text[end - 1], text[end]].get(hash((text[start], text[start + 1])), ()):
                if tuple(text[start : end + 1]) == pattern:
                    out |= self.owners[pattern]
            end += 1
        return out


#: The table built last in this process, by the number of its block: tasks of a block share it.
_BUILT: dict[str, WuManber] = {}


def _search(docs: DataFrame, id_col: str, text_col: str, items: list[tuple[int, list[str]]], window: int) -> DataFrame:
    held, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = WuManber(held.value, window)
        search = _BUILT[name]
        for batch in batches:
            found = [(key, item) for key, text in zip(batch[id_col], batch[text_col]) if text for item in sorted(search.find(words(text)))]
            yield pd.DataFrame(found, columns=[id_col, "item_id"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, item_id long")


def leaked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(id_col, item_id), once each: the document's words contain window consecutive words of the item's question, or of its passage.

    Items with fewer words in both are never found. Items are fetched in blocks of per_block items or WORDS_PER_BLOCK words, each block is one pass over the documents;
    null texts, ids of items that are null and empty tables give nothing.
    """
    spark: SparkSession = docs.sparkSession
    parts, block, size = [], [], 0
    for row in items.filter("item_id is not null").select("item_id", "question", "passage").distinct().toLocalIterator():
        own = [(row[0], w) for w in (words(row[1]), words(row[2])) if len(w) >= window]
        block += own
        size += sum(len(w) for _, w in own)
        if len(block) >= 2 * per_block or size >= WORDS_PER_BLOCK:
            parts.append(_search(docs, id_col, text_col, block, window))
            block, size = [], 0
    if block:
        parts.append(_search(docs, id_col, text_col, block, window))
    if not parts:
        return spark.createDataFrame([], f"`{id_col}` {dict(docs.dtypes)[id_col]}, item_id long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col(id_col).isNotNull()).distinct()
