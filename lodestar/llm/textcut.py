"""Cutting the texts of an Arrow batch into pieces at once, with numpy, and naming the distinct pieces."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """True for code points that belong to words: letters, digits, marks of those, underscore (``\\w``)."""
    import regex

    table = np.zeros(0x110000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table[[ord(c) for c in regex.findall(r"[\w\p{M}]", every)]] = True
    return table


def utf8_places(codes: np.ndarray, begin: np.ndarray, end: int) -> np.ndarray:
    """Byte offsets of code points ``begin`` (ascending, the first 0), with the end appended; sparing of memory."""
    width = np.ones(len(codes), np.uint8)
    for least in (0x80, 0x800, 0x10000):
        width += codes >= least
    sizes = np.add.reduceat(width, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
    out = np.concatenate([[0], np.cumsum(sizes)])
    assert out[-1] == end or not len(begin)
    return out


def binary_pieces(data: bytes, places: np.ndarray) -> pa.LargeBinaryArray:
    """Slices of ``data`` between consecutive places, without copies."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])


def coded_words(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Distinct words in UTF-8, the index of each word in text order, and where each text's words begin (n + 1 places)."""
    whole = "\n".join(texts) + "\n"
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    inside = word_table()[codes]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin = np.concatenate([[0], change])
    data = whole.encode("utf-8")
    pieces = binary_pieces(data, utf8_places(codes, begin, len(data)))
    own = np.flatnonzero(inside[begin])
    found = pieces.take(pa.array(own)).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(begin[own], np.concatenate([[0], ends]))
    return found.dictionary, found.indices.to_numpy(), first


def words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``coded_words`` with the distinct words as a list."""
    distinct, which, first = coded_words(texts)
    return distinct.to_pylist(), which, first


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
