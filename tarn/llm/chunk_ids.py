"""Token ids of whole texts through a per-worker cache of chunk encodings.

A chunk is a stretch of text whose ids do not depend on what surrounds it. Subclasses say
how a text is cut into chunks and how chunks that the cache lacks are encoded; gathering
the ids of a text from the flat table of cached ids is vectorised here. When the cache
takes more than about `limit` bytes, only the chunks met most often stay, in at most half
of that, so a worker's memory is bounded.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

#: What a cached chunk takes besides its characters: two objects, a dict entry, ids.
ENTRY_BYTES = 160


class ChunkIds:
    def __init__(self, limit: int = 48_000_000):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self.size, self.slots = 0, {}
        self.flat = np.zeros(0, np.uint32)
        self.lens, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, one after another, and how many each has."""
        raise NotImplementedError

    def _keep_frequent(self) -> None:
        names = list(self.slots)
        size = np.fromiter(map(len, names), np.int64, len(names)) + ENTRY_BYTES
        least = 1
        while (keep := np.flatnonzero(self.met > least)).size and int(size[keep].sum()) > self.limit // 2:
            least *= 2
        starts = (np.cumsum(self.lens) - self.lens)[keep]
        self.lens, self.met, self.size = self.lens[keep], self.met[keep] // 2, int(size[keep].sum())
        ends = np.cumsum(self.lens)
        self.flat = self.flat[np.repeat(starts - ends + self.lens, self.lens) + np.arange(int(self.lens.sum()))]
        self.slots = {names[i]: slot for slot, i in enumerate(keep.tolist())}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and the number of ids of each text."""
        parts = [self.chunks(t) for t in texts]
        n_parts = np.fromiter(map(len, parts), np.int64, len(parts))
        new = list(set().union(*parts).difference(self.slots))
        if new:
            ids, lens = self.encode_new(new)
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new)), strict=True))
            self.flat, self.lens = np.concatenate([self.flat, ids]), np.concatenate([self.lens, lens])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.size += sum(map(len, new)) + ENTRY_BYTES * len(new)
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(parts)), np.int64, int(n_parts.sum()))
        self.met += np.bincount(slots, minlength=len(self.met))
        starts = np.cumsum(self.lens) - self.lens
        size = self.lens[slots]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(starts[slots] - ends + size, size) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_parts)])]
        if self.size > self.limit:
            self._keep_frequent()
        return ids, np.diff(bounds)
