"""Hashes of all windows of a text, in whole arrays.

A window's polynomial is put together from shorter ones: those of a + b characters
are the ones of a characters times a power of the base plus the ones of b that
follow, so W characters take some log W steps over the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASE = 37
#: Bases of the two hashes that stand for a window's text where it is compared.
STRONG = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1
SPACE = 32
#: Texts that are hashed together at least.
TOGETHER = 32


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def polynomials(points: np.ndarray, window: int, base: int = BASE) -> np.ndarray:
    """Unfolded 64-bit hashes of all windows; none if the text is shorter than one."""
    n = len(points) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, size = None, 0, points, 1
    rest = window
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                m = len(points) - done - size + 1
                out = out[:m] * np.uint64(pow(base, size, 1 << 64)) + power[done : done + m]
            done += size
        rest >>= 1
        if rest:
            power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
    return out[:n]


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fold 64-bit hashes onto ``width`` bits; as signed numbers only at 64."""
    if width == 64:
        return hashes.view(np.int64)
    return (((hashes >> np.uint64(width)) ^ hashes) & np.uint64((1 << width) - 1)).view(np.int64)


def window_hashes(text: str, window: int, width: int) -> np.ndarray:
    """Hashes of all windows of a normalised text, which must be longer than one window."""
    points = code_points(text)
    return fold(polynomials(points, window), width) if len(points) > window else np.empty(0, np.int64)


def blank_windows(points: np.ndarray, window: int) -> np.ndarray:
    """True for windows of nothing but spaces."""
    letters = np.concatenate(([0], np.cumsum(points != SPACE)))
    return letters[window:] == letters[:-window]


def whitespace_hash(window: int, width: int) -> int:
    return int(window_hashes(" " * (window + 1), window, width)[0])


def theme_id(text: str) -> int:
    """32-bit FNV-1a of the UTF-8 bytes, and above it their number."""
    data, h = text.encode(), 2166136261
    for byte in data:
        h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
    return h | (len(data) << 32)


def theme_ids(texts: list[str]) -> np.ndarray:
    """``theme_id`` of many texts, all of one place at once while enough of them are that long."""
    data = [t.encode() for t in texts]
    order = sorted(range(len(data)), key=lambda i: -len(data[i]))
    h = np.full(len(data), 2166136261, np.uint32)
    sizes = np.array([len(data[i]) for i in order], np.int64)
    joined = np.frombuffer(b"".join(data[i] for i in order), np.uint8)
    starts = np.cumsum(sizes) - sizes
    live, at = len(data), 0
    while True:
        while live and sizes[live - 1] <= at:
            live -= 1
        if live < TOGETHER:
            break
        h[:live] = (h[:live] ^ joined[starts[:live] + at]) * np.uint32(16777619)
        at += 1
    for k in range(live):
        value = int(h[k])
        for byte in data[order[k]][at:]:
            value = ((value ^ byte) * 16777619) & 0xFFFFFFFF
        h[k] = value
    out = np.empty(len(data), np.int64)
    out[order] = h.astype(np.int64) | sizes << 32
    return out


def exploded(texts: DataFrame, keys: list[str], text: str, arrays, columns: list[tuple[str, str]]) -> DataFrame:
    """One row for each element that ``arrays(text)`` makes, with the row's keys (longs).

    ``arrays`` returns equally long arrays, one for each of ``columns``. Rows leave
    in batches as they are made; no array column is ever built.
    """
    types = {"long": pa.int64(), "int": pa.int32()}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [arrays(t or "") for t in part.column(len(keys)).to_pylist()]
                sizes = [len(m[0]) for m in made]
                if not sum(sizes):
                    continue
                own = [pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), sizes), pa.int64()) for i in range(len(keys))]
                new = [pa.array(np.concatenate([m[i] for m in made]), types[kind]) for i, (_, kind) in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*own, *new], names=[*keys, *(c for c, _ in columns)])

    schema = ", ".join([*(f"{k} long" for k in keys), *(f"{c} {kind}" for c, kind in columns)])
    return texts.select(*keys, text).mapInArrow(run, schema)
