"""Shared randomness as a pure function of (seed, stream, feature, sample).

Every random table of a sketch (uniforms, normals, signs, buckets, hash
coefficients) is an expression over Spark's ``xxhash64``.  Nothing is stored,
joined or broadcast: a task that sees feature ``f`` computes the same draw for
sample ``j`` as every other task, so train and test rows, partitions, retries
and reruns all agree.

The functions take and return SQL text for ``F.expr``.  A sketch evaluates
hundreds of draws per plan; text is parsed once in the JVM, where a tree of
Column objects would cost a Python round trip per node.
"""

from __future__ import annotations

import hashlib
import math

# 52 random bits plus a half step is exact in a double and never 0 or 1.
_STEP = 2.0**-52


def stream_key(seed: int, stream: str, party: str = "", repeat: int = 1) -> int:
    """Signed 64-bit key of one random stream; ``repeat`` doubles the seed."""
    text = f"{seed * 2 ** (repeat - 1)}:{party}:{stream}"
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big", signed=True)


def hash64(key: int | str, first: str, *rest: str) -> str:
    """64 hash bits of one or more whole numbers under a stream key, a number or SQL text that chooses one."""
    numbers = [f"cast({first} as bigint) ^ ({key if isinstance(key, str) else f'{key}L'})", *[f"cast({r} as bigint)" for r in rest]]
    return f"xxhash64({', '.join(numbers)})"


def uniform(key: int | str, first: str, *rest: str) -> str:
    """Uniform double in the open interval (0, 1)."""
    return f"((shiftrightunsigned({hash64(key, first, *rest)}, 12) + 0.5D) * {_STEP!r}D)"


def normal(key_radius: int, key_angle: int, first: str, *rest: str) -> str:
    """Standard normal by the Box-Muller transform of two uniforms."""
    radius = f"sqrt(-2.0D * ln({uniform(key_radius, first, *rest)}))"
    return f"({radius} * cos({2 * math.pi!r}D * {uniform(key_angle, first, *rest)}))"


def below(key: int, bound: int, first: str, *rest: str) -> str:
    """Uniform whole number in [0, bound)."""
    return f"cast(floor({uniform(key, first, *rest)} * {float(bound)!r}D) as bigint)"


def sign(key: int, first: str, *rest: str) -> str:
    """-1.0 or 1.0 with equal chance."""
    return f"if({uniform(key, first, *rest)} < 0.5D, -1.0D, 1.0D)"
