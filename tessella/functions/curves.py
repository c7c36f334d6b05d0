"""Hilbert and Morton curves: column expressions for DataFrames, integers and numpy for the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hilbert(x: int, y: int, order: int) -> int:
    """The place of cell (x, y) on the Hilbert curve of the given order."""
    return int(hilbert_np(np.array([x]), np.array([y]), order)[0])


def hilbert_np(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    x, y, key = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    for level in reversed(range(order)):
        right, up = (x >> level) & 1, (y >> level) & 1
        key = 4 * key + np.where(right == 1, 3 - up, up)
        flip, last = (up == 0) & (right == 1), (1 << level) - 1
        x, y = np.where(flip, last - (x & last), x & last), np.where(flip, last - (y & last), y & last)
        turn = up == 0
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return key


def hilbert_cell(key: int, order: int) -> tuple[int, int]:
    """The cell of a place on the curve."""
    x = y = 0
    for level in range(order):
        quadrant = (key >> (2 * level)) & 3
        right, up = quadrant >> 1, (quadrant ^ (quadrant >> 1)) & 1
        if not up:
            if right:
                x, y = (1 << level) - 1 - x, (1 << level) - 1 - y
            x, y = y, x
        x, y = x + (right << level), y + (up << level)
    return x, y


def _tables() -> tuple[int, int, int, int]:
    """Packed tables of two bits an entry, at 4 * state + quadrant: (digit, next state) by the quadrant's own bits, and
    (quadrant, next state) by the digit. A state says whether the axes are swapped (1) and both flipped (2)."""
    digits = nexts = quadrants = follows = 0
    for state in range(4):
        swap, flip = state & 1, state >> 1
        for quadrant in range(4):
            x, y = quadrant >> 1, quadrant & 1
            right, up = ((y, x) if swap else (x, y))[0] ^ flip, ((y, x) if swap else (x, y))[1] ^ flip
            digit, at = (3 * right) ^ up, 2 * (4 * state + quadrant)
            new = state if up else (swap ^ 1) | ((flip ^ right) << 1)
            digits |= digit << at
            nexts |= new << at
            quadrants |= quadrant << (2 * (4 * state + digit))
            follows |= new << (2 * (4 * state + digit))
    return digits, nexts, quadrants, follows


DIGITS, NEXTS, QUADRANTS, FOLLOWS = _tables()


def _entry(table: int, at: Column) -> Column:
    return F.call_function("shiftright", F.lit(table).cast("long"), (at * 2).cast("int")).bitwiseAND(F.lit(3))


def hilbert_column(x: Column, y: Column, order: int) -> Column:
    """The Hilbert key of cell columns. Each level refers to the state before it, so the expression grows with the square of the
    order, not exponentially, and code generation computes each state once."""
    key, state = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in reversed(range(order)):
        bit = lambda v, k=level: F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1))
        at = state * 4 + bit(x) * 2 + bit(y)
        key = key.bitwiseOR(F.shiftleft(_entry(DIGITS, at), 2 * level))
        state = _entry(NEXTS, at)
    return key


def hilbert_cell_columns(key: Column, order: int) -> tuple[Column, Column]:
    """The cell of a key column."""
    x = y = state = F.lit(0).cast("long")
    for level in reversed(range(order)):
        at = state * 4 + F.shiftright(key, 2 * level).bitwiseAND(F.lit(3))  # refers to the state once, like all that follows
        quadrant = _entry(QUADRANTS, at)
        x = x.bitwiseOR(F.shiftleft(F.shiftright(quadrant, 1), level))
        y = y.bitwiseOR(F.shiftleft(quadrant.bitwiseAND(F.lit(1)), level))
        state = _entry(FOLLOWS, at)
    return x, y


def with_hilbert(df: DataFrame, x: Column, y: Column, order: int, out: str = "h_key") -> DataFrame:
    """df with the Hilbert key of the cell columns x and y."""
    return df.withColumn(out, hilbert_column(x, y, order))


def with_hilbert_cell(df: DataFrame, key: Column, order: int, out: tuple[str, str] = ("cell_x", "cell_y")) -> DataFrame:
    """df with the cell of a Hilbert key."""
    return df.withColumns(dict(zip(out, hilbert_cell_columns(key, order), strict=True)))


#: Masks that spread the bits of a number of up to 24 bits, one shift each.
SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(v):
    for shift, mask in SPREAD:
        if isinstance(v, Column):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        else:
            v = (v | (v << shift)) & mask
    return v


def morton(x: int, y: int, x_first: bool = True) -> int:
    """Interleaved bits; x has the higher bit of each pair, or y if not x_first."""
    high, low = (x, y) if x_first else (y, x)
    return (_spread(high) << 1) | _spread(low)


def morton_np(x: np.ndarray, y: np.ndarray, x_first: bool = True) -> np.ndarray:
    high, low = (x, y) if x_first else (y, x)
    return (_spread(high.astype(np.int64)) << 1) | _spread(low.astype(np.int64))


def morton_column(x: Column, y: Column, x_first: bool = True) -> Column:
    high, low = (x, y) if x_first else (y, x)
    return F.shiftleft(_spread(high.cast("long")), 1).bitwiseOR(_spread(low.cast("long")))


def _gathered(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(SPREAD[-1][1]))
    for (shift, _), mask in zip(reversed(SPREAD), [m for _, m in reversed(SPREAD[:-1])] + [0x00000000FFFFFFFF], strict=True):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton_cell(key: Column, x_first: bool = True) -> tuple[Column, Column]:
    high, low = _gathered(F.shiftright(key, 1)), _gathered(key)
    return (high, low) if x_first else (low, high)
