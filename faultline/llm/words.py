"""Lower-cased words of letters, and labelled samples with a bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters are ASCII letters and everything beyond ASCII; a mark, digit or space ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str | None) -> list[bytes]:
    """Words as UTF-8, lower-cased."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def bounded(rows: DataFrame, key: Column, most: int, n: int | None = None) -> DataFrame:
    """About `most` of the rows, chosen by a digest of `key`; all of them if there are no more."""
    n = rows.count() if n is None else n
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


def grams(words: list[bytes], sizes: tuple[int, ...], buckets: int):
    """Hashed runs of bytes of each word between two marks, so that runs at its ends are its affixes: (bucket, word number)."""
    text = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint64)
    word = np.cumsum(text == 1) - 1
    hashed, of = [], []
    for n in sizes:
        if len(text) < n:
            continue
        value = np.full(len(text) - n + 1, n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + text[k : len(text) - n + 1 + k]
        inside = word[: len(value)] == word[n - 1 :]
        value = (value[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        hashed.append((value % np.uint64(buckets)).astype(np.int64))
        of.append(word[: len(inside)][inside])
    hashed, of = np.concatenate(hashed), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return hashed[order], of[order]


def sums_by(values, of, n: int):
    """Sums of the rows of `values` by `of` (ascending, 0..n-1)."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(of):
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[first]] = np.add.reduceat(values, first, axis=0)
    return out
