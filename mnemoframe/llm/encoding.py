"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's pattern; the distinct pieces of a batch are merged together as padded numpy matrices, one for each
range of lengths. In each round every row merges its leftmost pair of least rank, found by a hashed table of pairs, and is closed up.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Where the vocabulary files are, unless a path is given.
VOCABULARIES = "/opt/tokenizers"
#: Pieces of more bytes leave the matrices: they merge all equal least pairs at once, which gives the same ids.
LONG_BYTES = 128
#: Pieces whose ids a worker keeps.
CACHE_PIECES = 1 << 18
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressed table from a pair of ids to (rank of the merged id); the merged id is its rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        slot, open_, vals, mask = self._slot(keys), keys, np.array(merged, np.int32), np.uint64((1 << self.bits) - 1)
        self.probes = 0
        while len(open_):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(slot), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.values[slot[take]] = open_[take], vals[take]
            open_, vals, slot = open_[~take], vals[~take], (slot[~take] + np.uint64(1)) & mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it does not merge; negative ids never do."""
        keys = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        out = np.full(keys.shape, _NONE, np.int32)
        flat_keys, flat = keys.ravel(), out.ravel()
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot, mask = self._slot(flat_keys[open_]), np.uint64((1 << self.bits) - 1)
        for _ in range(self.probes):
            if not len(open_):
                break
            held = self.keys[slot]
            hit = held == flat_keys[open_]
            flat[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (held != np.uint64(2**64 - 1))
            open_, slot = open_[go], (slot[go] + np.uint64(1)) & mask
        return flat.reshape(keys.shape)


class Encoder:
    """Byte-level BPE from a rank file; encode(texts) gives lists of ids without special tokens."""

    def __init__(self, folder: str = VOCABULARIES, name: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> None:
        import regex

        with open(os.path.join(folder, name), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        #: Fixed value: the public pattern of this family of vocabularies.
        self.pattern = regex.compile(pattern or r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = ranks
        self.pairs = PairTable(ranks)
        self.known: dict[str, list[int]] = {}

    def _merge_matrix(self, rows: list[bytes]) -> list[list[int]]:
        """All rows, of like length, at once: each round merges the leftmost least pair of every row that has one."""
        length = np.array([len(r) for r in rows])
        width = int(length.max())
        ids = np.full((len(rows), width), -1, np.int32)
        filled = np.arange(width)[None, :] < length[:, None]
        ids[filled] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        result: list[list[int]] = [[] for _ in rows]
        at = np.arange(len(rows))
        rank = self.pairs.rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((len(rows), 0), np.int32)
        while len(at):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(at), int)
            least = rank[np.arange(len(at)), best] if rank.shape[1] else np.full(len(at), _NONE)
            done = least == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    row = ids[i]
                    result[at[i]] = row[row >= 0].tolist()
                ids, rank, at, best, least = ids[~done], rank[~done], at[~done], best[~done], least[~done]
                if not len(at):
                    break
            # close up: columns after the merged pair move left by one
            cols = np.arange(ids.shape[1] - 1)[None, :]
            moved = np.where(cols <= best[:, None], ids[:, :-1], ids[:, 1:])
            row = np.arange(len(at))
            moved[row, best] = least
            ids = moved
            if ids.shape[1] > 1:
                shifted = np.where(np.arange(ids.shape[1] - 1)[None, :] < best[:, None], rank[:, :-1], rank[:, 1:])
                for side in (best - 1, best):
                    ok = (side >= 0) & (side < ids.shape[1] - 1)
                    r, c = row[ok], side[ok]
                    shifted[r, c] = self.pairs.rank(ids[r, c], ids[r, c + 1])
                rank = shifted
            else:
                rank = np.empty((len(at), 0), np.int32)
            used = int((ids >= 0).sum(axis=1).max())
            if used < ids.shape[1]:
                ids, rank = ids[:, :used], rank[:, : max(0, used - 1)]
        return result

    def _merge_long(self, data: bytes) -> list[int]:
        """One long piece: every round merges, from the left, all pairs equal to the least one. A merged id only forms pairs of higher rank, so this gives what one at a time gives."""
        ids = self.single[np.frombuffer(data, np.uint8)]
        rank = self.pairs.rank(ids[:-1], ids[1:])
        while len(ids) > 1:
            least = rank.min()
            if least == _NONE:
                break
            hits = np.flatnonzero(rank == least)
            # of overlapping hits (a run of one id) every second one, from the left of each run, merges; other pairs with the
            # same merged id but another split do not overlap that way and wait for the next round
            first = hits[0]
            same = hits[(ids[hits] == ids[first]) & (ids[hits + 1] == ids[first + 1])]
            start = np.r_[True, np.diff(same) > 1]
            run = np.cumsum(start) - 1
            same = same[(same - same[start][run]) % 2 == 0]
            ids = ids.copy()
            ids[same] = least
            keep = np.ones(len(ids), bool)
            keep[same + 1] = False
            ids = ids[keep]
            touched = np.flatnonzero(keep)
            place = np.searchsorted(touched, same)
            rank = np.append(rank, _NONE)[keep][:-1]
            for side in (place - 1, place):
                ok = side[(side >= 0) & (side < len(ids) - 1)]
                rank[ok] = self.pairs.rank(ids[ok], ids[ok + 1])
        return ids.tolist()

    def _learn(self, pieces: set[str]) -> dict[str, list[int]]:
        out, buckets = {}, {}
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.whole.get(data)
            if whole is not None:
                out[piece] = [whole]
            elif len(data) > LONG_BYTES:
                out[piece] = self._merge_long(data)
            else:
                buckets.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
        for rows in buckets.values():
            for lo in range(0, len(rows), 8192):
                part = rows[lo : lo + 8192]
                for (piece, _), ids in zip(part, self._merge_matrix([d for _, d in part])):
                    out[piece] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        new = self._learn({p for pieces in cut for p in pieces} - self.known.keys())
        if len(self.known) + len(new) > CACHE_PIECES:
            needed = {p: self.known[p] for pieces in cut for p in pieces if p in self.known}
            self.known = needed
        self.known.update(new)
        known = self.known
        return [[i for p in pieces for i in known[p]] for pieces in cut]


@lru_cache(maxsize=2)
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = VOCABULARIES, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id_col, ids) of every row: the ids of the whole text as it is, without special tokens.

    Null and empty texts give an empty list. Rows stay as they are, repeated ones too; no shuffle takes place. The folder must be
    there on every executor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, name)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                yield pd.DataFrame({id_col: part[id_col], "ids": enc.encode(part[text_col].tolist())})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, ids array<int>")
