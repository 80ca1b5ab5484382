"""Randomness as a pure function of (seed, tag, keys).

A recomputed task, a retried stage or another partitioning gives the same draw, so noise cannot be
redrawn by accident. The seed is a secret: whoever knows it can subtract the noise. md5 gives
reproducible draws; this is not a hardened sampler against floating-point attacks.
"""

from __future__ import annotations

import math
import secrets

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh_seed() -> str:
    return secrets.token_hex(16)


def _cols(keys) -> list[Column]:
    return [(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys]


def uniform(seed, tag: str, *keys) -> Column:
    """A double in (0,1) from the first 52 bits of md5(seed|tag|keys...)."""
    text = F.concat_ws("|", *_cols([seed, tag, *keys]))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def fast_uniform(seed, tag: str, *keys) -> Column:
    """As ``uniform`` with xxhash64, for the generation loop, where no privacy noise is drawn."""
    args = [k if isinstance(k, Column) else F.lit(k) for k in (seed, tag, *keys)]
    bits = F.shiftrightunsigned(F.xxhash64(*args), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def gaussian(seed, tag: str, *keys) -> Column:
    """Standard normal by Box-Muller on two uniforms."""
    u1, u2 = uniform(seed, tag + ".u1", *keys), uniform(seed, tag + ".u2", *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gumbel(seed, tag: str, *keys) -> Column:
    return -F.ln(-F.ln(uniform(seed, tag, *keys)))


def laplace(seed, tag: str, *keys) -> Column:
    u = uniform(seed, tag, *keys) - F.lit(0.5)
    return -F.signum(u) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(u))


# The same draws as SQL text, for expressions that are rebuilt every round.


def _text(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def uniform_sql(seed, tag: str, *keys: str) -> str:
    """``uniform`` with SQL expressions as keys."""
    parts = [_text(seed), _text(tag), *[f"string({k})" for k in keys]]
    bits = f"cast(conv(substring(md5(concat_ws('|', {', '.join(parts)})), 1, 13), 16, 10) as bigint)"
    return f"((cast({bits} as double) + 0.5D) / {float(1 << 52)!r}D)"


def fast_uniform_sql(seed, tag: str, *keys: str) -> str:
    bits = f"shiftrightunsigned(xxhash64({', '.join([_text(seed), _text(tag), *keys])}), 12)"
    return f"((cast({bits} as double) + 0.5D) / {float(1 << 52)!r}D)"


# xxhash64 of whole numbers as Spark has it, over arrays. Seeds are the hashes of the arguments before, 42 at first.

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _bits(x) -> np.ndarray:
    return np.atleast_1d(np.asarray(x, np.int64)).view(np.uint64)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def hash_long(x, seed) -> np.ndarray:
    h = (_bits(seed) + _P5 + np.uint64(8)) ^ (_rotated(_bits(x) * _P2, 31) * _P1)
    return _mixed(_rotated(h, 27) * _P1 + _P4)


def hash_int(x, seed) -> np.ndarray:
    h = (_bits(seed) + _P5 + np.uint64(4)) ^ ((_bits(x) & np.uint64(0xFFFFFFFF)) * _P1)
    return _mixed(_rotated(h, 23) * _P2 + _P3)


def uniform_of(h: np.ndarray) -> np.ndarray:
    """Doubles in (0,1) from hashes, as ``fast_uniform`` makes them."""
    return ((h.view(np.uint64) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
