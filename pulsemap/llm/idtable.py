"""Token ids of strings that repeat, kept in flat arrays and gathered for whole columns at once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + count[i] - 1 for each i, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class IdTable:
    """Codes of strings and the ids of codes. Unknown strings go to ``learn``, which gives their ids, one
    string's after the other's, and how many each has.

    ``most`` bounds what is remembered from one batch to the next, in strings and, eight times that, in
    ids; beyond it only strings met in several batches stay. Results do not depend on it.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self._empty()

    def _empty(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.first, self.count, self.met = (np.zeros(0, t) for t in ("<u4", np.int64, np.int64, np.int64))

    def make_room(self) -> None:
        """To be called between batches: codes given before are void afterwards."""
        if len(self.code) <= self.most and len(self.flat) <= 8 * self.most:
            return
        stay = np.flatnonzero(self.met > 1)
        if len(stay) > self.most // 2 or self.count[stay].sum() > 4 * self.most:
            self._empty()
            return
        new = np.full(len(self.met), -1)
        new[stay] = np.arange(len(stay))
        self.code = {w: c for w, c in zip(self.code, new[list(self.code.values())].tolist(), strict=True) if c >= 0}
        self.flat, self.count = self.flat[ranges(self.first[stay], self.count[stay])], self.count[stay]
        self.first, self.met = np.cumsum(self.count) - self.count, np.zeros(len(stay), np.int64)

    def codes(self, strings: pa.Array) -> np.ndarray:
        """The code of each string."""
        known, coded = self.code, strings.dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = [words[i] for i in unknown.tolist()]
            ids, count = self.learn(new)
            at[unknown] = np.arange(len(self.met), len(self.met) + len(new))
            known.update(zip(new, at[unknown].tolist(), strict=True))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
            self.flat = np.concatenate([self.flat, ids])
            self.count = np.concatenate([self.count, count])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[at] += 1
        return at[coded.indices.to_numpy()]

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the codes, one code's after the other's, and where each code's begin (with the end)."""
        count = self.count[codes]
        return self.flat[ranges(self.first[codes], count)], np.concatenate([[0], np.cumsum(count)])


def flattened(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What IdTable wants of ``learn``, from the ids of each string."""
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def batches_of(batch: pa.RecordBatch, column: int, most_bytes: int) -> list[pa.RecordBatch]:
    """The batch in slices whose strings in ``column`` come to about ``most_bytes``; a row is never cut."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    if not len(size):
        return []
    part = (size - 1) // most_bytes
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
