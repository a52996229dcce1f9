"""Stretches of text that are encoded alike wherever they stand: found for many texts at once, and remembered by a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def distinct_units(data: bytes, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct stretches of ``data`` that begin at ``starts`` and end where the next one begins, and which of them stands where."""
    edges = np.append(starts, len(data)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    _, cut, raw = coded.dictionary.buffers()
    cut, raw = np.frombuffer(cut, np.int64, len(coded.dictionary) + 1).tolist(), raw.to_pybytes()  # faster than to_pylist
    return [raw[x:y] for x, y in zip(cut, cut[1:])], coded.indices.to_numpy()


def gathered(pieces: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (32 bits) of the units ``which``, one unit after the other, and how many ids each of them has."""
    flat = np.frombuffer(b"".join(pieces), "<i4")
    size = np.fromiter(map(len, pieces), np.int32, len(pieces)) // 4
    n = size[which]
    upto = np.cumsum(n, dtype=np.int32)
    at = np.repeat((np.cumsum(size, dtype=np.int32) - size)[which] - upto + n, n)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], n


class Remembered:
    """Ids of units in two generations of ``most`` / 2 units, so that frequent units stay when rare ones are forgotten."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int):
        self.encode, self.most = encode, most
        self.fresh: dict[bytes, bytes] = {}
        self.stale: dict[bytes, bytes] = {}

    def ids(self, units: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct ``units`` as bytes."""
        if 2 * len(self.fresh) > self.most:
            self.fresh, self.stale = {}, self.fresh
        out = list(map(self.fresh.get, units))
        new = []
        for k in [k for k, found in enumerate(out) if found is None]:
            if (found := self.stale.get(units[k])) is None:
                new.append(k)
            else:
                out[k] = self.fresh[units[k]] = found
        for k, found in zip(new, self.encode([units[k] for k in new])):
            out[k] = self.fresh[units[k]] = found
        return out
