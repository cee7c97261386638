"""Predicates and decision tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, long, lookup, num

# Cards and their worth.
CARD_VALUES = {"ace": 11, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "jack": 10, "queen": 10, "king": 10}
# Rings by radius and points, and interest tiers by upper bound and rate.
RINGS = ((1.0, 10), (5.0, 5), (10.0, 1))
RATES = ((0.0, 3.213), (1000.0, 0.5), (5000.0, 1.621))
TOP_RATE = 2.475
# Log markers.
LOG_MARKERS = {"❗": "recommendation", "\U0001f50d": "search", "☀": "weather"}


def can_fast_attack(knight: Column | str) -> Column:
    return ~col(knight)


def can_spy(knight: Column | str, archer: Column | str, prisoner: Column | str) -> Column:
    return col(knight) | col(archer) | col(prisoner)


def can_signal_prisoner(archer: Column | str, prisoner: Column | str) -> Column:
    return ~col(archer) & col(prisoner)


def can_free_prisoner(knight: Column | str, archer: Column | str, prisoner: Column | str, dog: Column | str) -> Column:
    return ~col(archer) & (col(dog) | (col(prisoner) & ~col(knight)))


def card_value(card: Column | str) -> Column:
    """The worth of a card; 0 for anything else."""
    return F.coalesce(F.try_element_at(lookup(CARD_VALUES), col(card)), F.lit(0)).cast("long")


def first_turn(card1: Column | str, card2: Column | str, dealer: Column | str) -> Column:
    """P for a pair of aces, W for 21 against less than ten, H for hands worth improving, else S."""
    hand, against = card_value(card1) + card_value(card2), card_value(dealer)
    aces = (col(card1) == "ace") & (col(card2) == "ace")
    return F.when(aces, "P").when((hand == 21) & (against < 10), "W").when((hand <= 11) | (hand.between(12, 16) & (against >= 7)), "H").otherwise("S")


def needs_license(kind: Column | str) -> Column:
    return F.coalesce(col(kind).isin("car", "truck"), F.lit(False))


def choose_vehicle(a: Column | str, b: Column | str) -> Column:
    return F.concat(F.least(col(a), col(b)), F.lit(" is clearly the better choice."))


def resell_price(price: Column | str, age: Column | str) -> Column:
    """Half from ten years on, four fifths under three, seven tenths between; a NaN age counts as between."""
    known = ~F.isnan(col(age))
    share = F.when(known & (col(age) >= 10), 0.5).when(known & (col(age) < 3), 0.8).otherwise(0.7)
    return F.when(col(age).isNotNull(), col(price) * share)


def is_triangle(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """Positive sides of which none is longer than the others together; NaN is no side."""
    a, b, c = col(a), col(b), col(c)
    real = ~(F.isnan(a) | F.isnan(b) | F.isnan(c))
    return real & (a > 0) & (b > 0) & (c > 0) & (a + b >= c) & (a + c >= b) & (b + c >= a)


def all_equal(a: Column | str, b: Column | str, c: Column | str) -> Column:
    return (col(a) == col(b)) & (col(b) == col(c))


def any_two_equal(a: Column | str, b: Column | str, c: Column | str) -> Column:
    return (col(a) == col(b)) | (col(a) == col(c)) | (col(b) == col(c))


def triangle_kind(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """0 no triangle, 1 equilateral, 2 isosceles, 3 scalene."""
    return F.when(~is_triangle(a, b, c), 0).when(all_equal(a, b, c), 1).when(any_two_equal(a, b, c), 2).otherwise(3)


def distance_from_center(x: Column | str, y: Column | str) -> Column:
    return F.sqrt(col(x) * col(x) + col(y) * col(y))


def ring_score(x: Column | str, y: Column | str) -> Column:
    """Points of the innermost ring that holds (x, y); 0 outside all, and for NaN."""
    at = distance_from_center(x, y)
    out = F.when(F.isnan(at), 0)
    for radius, points in RINGS:
        out = out.when(at <= radius, points)
    return F.when(at.isNotNull(), out.otherwise(0)).cast("long")


def interest_rate(balance: Column | str) -> Column:
    """The rate of the tier as a 32-bit float."""
    balance, out = col(balance), None
    for bound, rate in RATES:
        out = (F if out is None else out).when(balance < bound, F.lit(rate).cast("float"))
    return F.when(balance.isNotNull(), out.otherwise(F.lit(TOP_RATE).cast("float")))


def is_leap_year(year: Column | str) -> Column:
    return (col(year) % 400 == 0) | ((col(year) % 4 == 0) & (col(year) % 100 != 0))


def log_application(log: Column | str) -> Column:
    """What the first marker of a line says; "default" without one."""
    marker = F.regexp_extract(col(log), f"[{''.join(LOG_MARKERS)}]", 0)
    return F.when(col(log).isNotNull(), F.coalesce(F.try_element_at(lookup(LOG_MARKERS), marker), F.lit("default")))


def within_limit(log: Column | str, limit: Column | int) -> Column:
    """At most so many characters."""
    return F.char_length(col(log)) <= num(limit)


def has_stock(in_stock: Column | str) -> Column:
    return col(in_stock) > 0


def can_finish_strict(speed: Column | str, drain: Column | str, battery: Column | str, track: Column | str) -> Column:
    """Whether full drives on the battery cover the track; NULL without drain."""
    drives = _div(col(battery), col(drain))
    return drives * col(speed) >= col(track)


def can_finish_floored(speed: Column | str, drain: Column | str, battery: Column | str, track: Column | str) -> Column:
    """Whether the battery lasts for the whole drives that fit on the track; NULL without speed."""
    return col(battery) >= _div(col(track), col(speed)) * col(drain)


def _div(a: Column, b: Column) -> Column:
    """Integer division towards zero; NULL for a zero divisor."""
    safe = F.when(b != 0, b)
    return ((a.cast("long") - a.cast("long") % safe) / safe).cast("long")


def integer_division(a: Column | str | int, b: Column | str | int) -> Column:
    return _div(long(num(a)), long(num(b)))
