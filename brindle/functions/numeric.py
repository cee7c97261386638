"""Number and time functions."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from .columns import col, long, num
from .decisions import RATES, TOP_RATE, integer_division, interest_rate

# Fixed values.
OVEN_MINUTES, MINUTES_PER_LAYER, GIGASECOND = 40, 2, 1_000_000_000
CAR_COST, TEN_CARS_COST = 10_000, 95_000


def cars_per_hour(rate: Column | str, success: Column | str) -> Column:
    return col(rate).cast("double") * col(success) / F.lit(100.0)


def cars_per_minute(rate: Column | str, success: Column | str) -> Column:
    """Truncated."""
    return (cars_per_hour(rate, success) / F.lit(60.0)).cast("long")


def cars_cost(cars: Column | str) -> Column:
    """Ten at a time are cheaper."""
    return integer_division(cars, 10) * TEN_CARS_COST + col(cars).cast("long") % 10 * CAR_COST


def square_of_sum(n: Column | str) -> Column:
    s = integer_division(long(num(n)) * (long(num(n)) + 1), 2)
    return s * s


def sum_of_squares(n: Column | str) -> Column:
    n = long(num(n))
    return integer_division(n * (n + 1) * (2 * n + 1), 6)


def squares_difference(n: Column | str) -> Column:
    return square_of_sum(n) - sum_of_squares(n)


def interest(balance: Column | str) -> Column:
    return col(balance) * interest_rate(balance).cast("double") * F.lit(0.01)


def annual_balance(balance: Column | str) -> Column:
    return col(balance) + interest(balance)


def oven_time_left(minutes: Column | str) -> Column:
    return F.lit(OVEN_MINUTES) - col(minutes)


def layering_time(layers: Column | str) -> Column:
    return MINUTES_PER_LAYER * col(layers)


def elapsed_time(layers: Column | str, minutes: Column | str) -> Column:
    return layering_time(layers) + col(minutes)


def add_gigasecond(moment: Column | str) -> Column:
    """A thousand million seconds later, for timestamps with or without zone."""
    return col(moment) + F.expr(f"INTERVAL {GIGASECOND} SECONDS")


# ---- loops, whole batches at a time ------------------------------------------------------------------------


#: Steps that one look-up makes: each low part of so many bits has its own.
COLLATZ_BITS = 16


@functools.cache
def _collatz_table(bits: int = COLLATZ_BITS) -> tuple[np.ndarray, ...]:
    """(factors, rests, steps, steps down to 1) by the low ``bits`` bits b.

    Halving ``bits`` times, with 3n + 1 before each halving of an odd number, takes ``a * 2**bits + b`` to
    ``a * factor + rest``; the last array is for numbers below ``2**bits`` themselves.
    """
    low = np.arange(1 << bits, dtype=np.int64)
    rest, factor, steps = low.copy(), np.ones_like(low), np.full_like(low, bits)
    for _ in range(bits):
        odd = rest & 1 == 1
        rest = np.where(odd, (3 * rest + 1) >> 1, rest >> 1)
        factor, steps = np.where(odd, 3 * factor, factor), steps + odd
    down, value, live = np.zeros_like(low), low.copy(), low > 1
    while live.any():
        value[live] = np.where(value[live] & 1 == 1, 3 * value[live] + 1, value[live] >> 1)
        down[live] += 1
        live &= value > 1
    return factor, rest, steps, down


@pandas_udf(LongType())
def collatz_steps(n: pd.Series) -> pd.Series:
    """Steps down to 1; NULL below 1.  A look-up makes many steps at once; chains that leave 64 bits go on in unbounded integers."""
    factor, rest, steps, down = _collatz_table()
    top, low = COLLATZ_BITS, (1 << COLLATZ_BITS) - 1
    value = n.fillna(0).to_numpy(np.int64).copy()
    total = np.zeros(len(value), np.int64)
    live = np.flatnonzero(value > low)
    most = (2**63 - 1 - rest) // factor
    while len(live):
        high, at = value[live] >> top, value[live] & low
        if (over := high > most[at]).any():
            for i in live[over]:
                big = int(value[i])
                while big > 1:
                    big, total[i] = (big >> 1 if big % 2 == 0 else 3 * big + 1), total[i] + 1
                value[i] = 1
            live = live[~over]
            continue
        value[live] = high * factor[at] + rest[at]
        total[live] += steps[at]
        live = live[value[live] > low]
    total += down[np.clip(value, 0, low)]
    return pd.Series(total, dtype="Int64").mask(n.isna().to_numpy() | (n.fillna(0) < 1).to_numpy())


def collatz_error(n: Column | str) -> Column:
    """Why a number has no steps; NULL if it has."""
    return F.when(col(n) < 1, F.format_string("Error with value %d: Input must be greater than zero", col(n).cast("long")))


SMALL = 3000


def _small_primes() -> list[int]:
    return [p for p in range(2, SMALL) if all(p % d for d in range(2, math.isqrt(p) + 1))]


def _large_factors(n: int) -> list[int]:
    """Prime factors of an integer without small ones, ascending, by Pollard's rho."""
    out, waiting = [], [n] if n > 1 else []
    while waiting:
        n = waiting.pop()
        if n < SMALL * SMALL or _is_prime(n):
            out.append(n)
        else:
            d = _divisor(n)
            waiting += [d, n // d]
    return sorted(out)


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all 64-bit integers."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _divisor(n: int) -> int:
    for c in range(1, n):
        x = y = 2
        d = 1
        while d == 1:
            x = (x * x + c) % n
            y = (y * y + c) % n
            y = (y * y + c) % n
            d = math.gcd(x - y, n)
        if d != n:
            return d
    return n


@pandas_udf(ArrayType(LongType()))
def prime_factors(n: pd.Series) -> pd.Series:
    """Prime factors in ascending order, repeated as often as they divide; NULL below 1.

    Small primes divide all numbers of a batch at once; what they leave is prime, or goes to Pollard's rho.
    """
    valid = (n.notna() & (n.fillna(0) >= 1)).to_numpy()
    left = np.where(valid, n.fillna(1), 1).astype(np.int64)
    rows, factors = [], []
    for p in _small_primes():
        at = np.flatnonzero(left % p == 0)
        while len(at):
            left[at] //= p
            rows.append(at), factors.append(np.full(len(at), p))
            at = at[left[at] % p == 0]
        if (left < p * p).all():
            break
    for i in np.flatnonzero(left > 1):
        more = _large_factors(int(left[i])) if left[i] >= SMALL * SMALL else [int(left[i])]
        rows.append(np.full(len(more), i)), factors.append(np.array(more, np.int64))
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    factor = np.concatenate(factors) if factors else np.empty(0, np.int64)
    order = np.lexsort((factor, row))
    parts = np.split(factor[order], np.searchsorted(row[order], np.arange(1, len(n)))) if len(n) else []
    return pd.Series([x if ok else None for x, ok in zip(parts, valid)], dtype=object)


@pandas_udf(LongType())
def years_to_target(balance: pd.Series, target: pd.Series) -> pd.Series:
    """Whole years of interest until a balance reaches its target; NULL for one that never does."""
    b, t = balance.to_numpy(np.float64).copy(), target.to_numpy(np.float64)
    bounds = np.array([bound for bound, _ in RATES])
    rates = np.array([rate for _, rate in RATES] + [TOP_RATE], np.float32).astype(np.float64)
    years, live = np.zeros(len(b), np.int64), (b > 0) & (b < t) & np.isfinite(t)
    never = np.isnan(b) | np.isnan(t) | ((b < t) & ~live)
    while live.any():
        now = b[live]
        b[live] = now + now * rates[np.searchsorted(bounds, now, side="right")] * 0.01
        years[live] += 1
        live &= b < t
    return pd.Series(years, dtype="Int64").mask(never)
