"""Numpy arrays in folders of the shared store: written by the tasks that make them, mapped or read by the tasks that look things up."""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Callable, Mapping

import numpy as np
from pyarrow import fs

from gradeloom.llm.common import makedirs

CACHE_BYTES = 128 << 20


def write_arrays(folder: str, arrays: Mapping[str, np.ndarray]) -> None:
    """Put each array under its name. Attempts of one task write the same bytes, so a second one may replace the first."""
    system, at = makedirs(folder)
    for name, array in arrays.items():
        out = io.BytesIO()
        np.save(out, array)
        part = f"{at}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(out.getvalue())
        system.move(part, f"{at}/{name}.npy")


class ShardStore:
    """Shards ``root``/000000, ... of arrays, each made into an object by ``load``.

    Where the store is a mounted file system arrays are mapped, so the workers of a machine share its page cache. What ``load`` made
    is kept for the shards used last, up to a fixed number of bytes (``load`` gives (object, bytes)).
    """

    def __init__(self, root: str, load: Callable[[Callable[[str], np.ndarray]], tuple[object, int]]):
        self.system, self.at = makedirs(root)
        self.load, self.kept, self.held = load, OrderedDict(), 0

    def _array(self, k: int, name: str) -> np.ndarray:
        path = f"{self.at}/{k:06d}/{name}.npy"
        if isinstance(self.system, fs.LocalFileSystem):
            return np.load(path, mmap_mode="r")
        with self.system.open_input_stream(path) as f:
            return np.load(io.BytesIO(f.read()))

    def shard(self, k: int):
        if k not in self.kept:
            self.kept[k] = self.load(lambda name: self._array(k, name))
            self.held += self.kept[k][1]
            while len(self.kept) > 1 and self.held > CACHE_BYTES:
                self.held -= self.kept.popitem(last=False)[1][1]
        self.kept.move_to_end(k)
        return self.kept[k][0]


def by_shard(shard: np.ndarray):
    """(shard, indices of its rows) for each shard that has rows."""
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    for k, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(shard)], strict=True):
        yield k, order[a:b]
