"""Array, map and positional functions.  Positions count from 0."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import chars, col, long, lookup, num, total

# Units of sale, colour bands in order of their digit, layer amounts.
UNITS = {"quarter_of_a_dozen": 3, "half_of_a_dozen": 6, "dozen": 12, "small_gross": 120, "gross": 144, "great_gross": 1728}
COLOURS = ("black", "brown", "red", "orange", "yellow", "green", "blue", "violet", "grey", "white")
FAVOURITES = (2, 6, 9)
NOODLES_PER_LAYER, SAUCE_PER_LAYER, MINUTES_PER_LAYER = 50, 0.2, 2


def keep(array: Column | str, predicate: Callable[[Column], Column]) -> Column:
    """The elements for which the predicate holds, in order."""
    return F.filter(col(array), lambda x: F.coalesce(predicate(x), F.lit(False)))


def discard(array: Column | str, predicate: Callable[[Column], Column]) -> Column:
    """All other elements: those for which the predicate is false or unknown."""
    return F.filter(col(array), lambda x: ~F.coalesce(predicate(x), F.lit(False)))


# ---- series by position --------------------------------------------------------------------------------


def series_total(counts: Column | str) -> Column:
    return total(col(counts))


def week_total(counts: Column | str, week: int | Column | str) -> Column:
    """The sum of the week-th seven values, from 1; 0 for a week that isn't whole."""
    w = long(num(week))
    whole = (w >= 1) & (F.size(col(counts)) >= 7 * w)
    return F.when(whole, total(F.slice(col(counts), (7 * F.greatest(w, long(1)) - 6).cast("int"), 7))).otherwise(long(0))


def fix_alternate(counts: Column | str) -> Column:
    """One more at every even position."""
    return F.transform(col(counts), lambda x, i: x + F.when(i % 2 == 0, 1).otherwise(0))


#: How often 2, 3, 5 and 7 are in each digit above 0.
_EXPONENTS = {1: (0, 0, 0, 0), 2: (1, 0, 0, 0), 3: (0, 1, 0, 0), 4: (2, 0, 0, 0), 5: (0, 0, 1, 0), 6: (1, 1, 0, 0), 7: (0, 0, 0, 1), 8: (3, 0, 0, 0), 9: (0, 2, 0, 0)}


def _largest(digits: str, span: int) -> int:
    """The largest product of ``span`` digits in a row, from running sums of exponents: linear in the length, whatever the span."""
    table = np.zeros((256, 5), np.int64)
    table[48, 4] = 1
    for digit, powers in _EXPONENTS.items():
        table[48 + digit, :4] = powers
    runs = np.vstack((np.zeros((1, 5), np.int64), np.cumsum(table[np.frombuffer(digits.encode(), np.uint8)], axis=0)))
    runs = runs[span:] - runs[: len(runs) - span]
    whole = runs[runs[:, 4] == 0, :4]
    if not len(whole):
        return 0
    size = whole @ np.log2([2, 3, 5, 7])
    near = np.unique(whole[size >= size.max() - 1e-6], axis=0)  # rounding can't tell these apart
    return max(2 ** int(a) * 3 ** int(b) * 5 ** int(c) * 7 ** int(d) for a, b, c, d in near)


#: Products of up to so many digits are below 2**63.
_SHORT_SPAN = 19


def _largest_of_many(texts: pd.Series, span: int) -> pd.Series:
    """The largest product of up to _SHORT_SPAN digits in a row of each text, all texts at once: longer products are made of two shorter ones."""
    known = np.flatnonzero(texts.notna().to_numpy())
    out = pd.array(np.zeros(len(texts), np.int64), dtype="Int64")
    out[texts.isna().to_numpy()] = pd.NA
    if not len(known):
        return pd.Series(out)
    texts = texts.iloc[known]
    at = np.cumsum(texts.str.len().to_numpy(np.int64))
    power = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int64) - 48  # products of 1, 2, 4 ... digits from each place on
    product, done, n = np.ones(len(power) + 1, np.int64), 0, 1
    while True:
        if span & n:
            product = product[: len(power) - done] * power[done:]
            done += n
        if done == span:
            break
        power = power[:-n] * power[n:]
        n *= 2
    begin = np.concatenate(([0], at[:-1]))
    if len(begin) > 1:
        for back in range(1, span):  # these begin in one text and end in the next
            product[begin[1:] - back] = 0
    out[known] = np.maximum.reduceat(product, begin)
    return pd.Series(out)


def largest_product(digits: Column | str, span: int) -> Column:
    """The largest product of ``span`` digits in a row; NULL for a negative or too long span or other characters.

    A span of 0 gives 1, or 0 for an empty string.  Products are decimals of 38 digits, which spans of up to 39 never
    leave; a larger one is NULL.
    """
    one, zero = F.lit(1).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")
    good = col(digits).rlike("^[0-9]*$") & ~col(digits).contains("\n") & (F.length(col(digits)) >= span)
    if span < 0:
        return F.lit(None).cast("decimal(38,0)")
    if span == 0:
        return F.when(good, F.when(F.length(col(digits)) > 0, one).otherwise(zero))

    if span <= _SHORT_SPAN:

        @F.pandas_udf("bigint")
        def short(texts: pd.Series) -> pd.Series:
            return _largest_of_many(texts, span)

        return short(F.when(good, col(digits))).cast("decimal(38,0)")

    @F.pandas_udf("decimal(38,0)")
    def largest(texts: pd.Series) -> pd.Series:
        found = [None if t is None else _largest(t, span) for t in texts]
        return pd.Series([None if v is None or v >= 10**38 else Decimal(v) for v in found], dtype=object)

    return largest(F.when(good, col(digits)))


# ---- lists ------------------------------------------------------------------------------------------------


def favourite_cards() -> Column:
    return F.array(*[long(x) for x in FAVOURITES])


def get_item(array: Column | str, index: int | Column) -> Column:
    """The element, -1 outside the array."""
    i = num(index)
    return F.when((i >= 0) & (i < F.size(col(array))), F.get(col(array), i.cast("int"))).otherwise(-1)


def set_item(array: Column | str, index: int | Column, value: int | Column) -> Column:
    """The array with one element replaced, or the value at its end for an index outside."""
    a, i, v = col(array), num(index), num(value)
    return F.when((i >= 0) & (i < F.size(a)), F.transform(a, lambda x, j: F.when(j == i, v).otherwise(x))).otherwise(F.array_append(a, v))


def prepend_items(array: Column | str, values: Column | str) -> Column:
    return F.concat(col(values), col(array))


def remove_item(array: Column | str, index: int | Column) -> Column:
    """The array without one element; unchanged for an index outside."""
    i = num(index)
    return F.filter(col(array), lambda x, j: j != i)


# ---- look-ups ----------------------------------------------------------------------------------------------


def units() -> Column:
    return lookup({k: v for k, v in UNITS.items()}).cast("map<string,bigint>")


def new_bill() -> Column:
    return F.create_map().cast("map<string,bigint>")


def bill_quantity(bill: Column | str, item: str | Column) -> Column:
    """Struct of the quantity, 0 for an item that isn't there, and whether it is."""
    key = F.lit(item) if isinstance(item, str) else item
    return F.struct(F.coalesce(F.try_element_at(col(bill), key), long(0)).alias("quantity"), F.map_contains_key(col(bill), key).alias("there"))


def colours() -> Column:
    return F.array(*map(F.lit, COLOURS))


def colour_code(colour: Column | str) -> Column:
    """The digit of a band, -1 for an unknown colour."""
    return F.array_position(colours(), col(colour)) - 1


def colour_value(bands: Column | str) -> Column:
    """Two digits of the first two bands, unknown ones 0; 0 for fewer bands."""
    digit = lambda i: F.greatest(F.coalesce(colour_code(F.get(col(bands), F.lit(i))), long(0)), long(0))
    return F.when(F.size(col(bands)) < 2, long(0)).otherwise(digit(0) * 10 + digit(1))


# ---- recipes -------------------------------------------------------------------------------------------------


def layers_time(layers: Column | str, minutes: int | Column) -> Column:
    """Minutes for all layers; 0 minutes a layer means the usual two."""
    each = long(num(minutes))
    return F.size(col(layers)) * F.when(each == 0, long(MINUTES_PER_LAYER)).otherwise(each)


def layer_quantities(layers: Column | str) -> Column:
    """Struct of noodles and sauce for all layers."""
    n = lambda name: F.size(F.filter(col(layers), lambda x: F.lower(x) == name)).cast("long")
    sauce = F.aggregate(F.filter(col(layers), lambda x: F.lower(x) == "sauce"), F.lit(0.0), lambda a, x: a + F.lit(SAUCE_PER_LAYER))
    return F.struct((n("noodles") * NOODLES_PER_LAYER).alias("noodles"), sauce.alias("sauce"))


def add_secret_ingredient(friends: Column | str, mine: Column | str) -> Column:
    """My list with its last element replaced by the friend's last; NULL if either is empty."""
    f, m = col(friends), col(mine)
    return F.when((F.size(f) > 0) & (F.size(m) > 0), F.concat(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), F.array(F.try_element_at(f, F.lit(-1)))))


def scale_recipe(quantities: Column | str, portions: int | Column) -> Column:
    """Amounts for two portions scaled to any number."""
    factor = num(portions).cast("double") / F.lit(2.0)
    return F.transform(col(quantities), lambda q: q * factor)


# ---- boards: maps from file to an array of squares ---------------------------------------------------------------


def _occupied(squares: Column) -> Column:
    return F.size(F.filter(squares, lambda x: x)).cast("long")


def count_in_file(board: Column | str, file: str) -> Column:
    """Occupied squares of a file, 0 for one that isn't there."""
    return F.coalesce(_occupied(F.try_element_at(col(board), F.lit(file))), long(0))


def count_in_rank(board: Column | str, rank: int) -> Column:
    """Files whose square at a rank from 1 to 8 is occupied; 0 for other ranks."""
    if not 1 <= rank <= 8:
        return long(0)
    return F.size(F.filter(F.map_values(col(board)), lambda f: F.coalesce(F.get(f, F.lit(rank - 1)), F.lit(False)))).cast("long")


def count_squares(board: Column | str) -> Column:
    return F.aggregate(F.map_values(col(board)), long(0), lambda a, f: a + F.size(f))


def count_occupied(board: Column | str) -> Column:
    return F.aggregate(F.map_values(col(board)), long(0), lambda a, f: a + _occupied(f))
