"""String functions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import chars, col, long, lookup, num, total

LOWER, UPPER = string.ascii_lowercase, string.ascii_uppercase

# Letters worth more than one point.
LETTER_POINTS = {**dict.fromkeys("DG", 2), **dict.fromkeys("BCMP", 3), **dict.fromkeys("FHVWY", 4), "K": 5, **dict.fromkeys("JX", 8), **dict.fromkeys("QZ", 10)}
# Numerals of each decimal place, and greetings by language.
NUMERALS = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))
GREETINGS = {"Italian": "Ciao %s!", "Portuguese": "Olá %s!"}
TEMPERATURE_UNITS, SPEED_UNITS = ("°C", "°F"), ("km/h", "mph")


# ---- words and letters ------------------------------------------------------------------------------


def word_parts(phrase: Column | str) -> Column:
    """What lies between white space and punctuation but for apostrophes, lowered; ``clean_word`` makes words of it."""
    return F.split(F.lower(col(phrase)), r"(?U)[\s[\p{P}&&[^']]]+")


def clean_word(part: Column | str) -> Column:
    """A part without marks and outer apostrophes; empty if nothing is left."""
    return trim_quotes(F.regexp_replace(col(part), r"[^\p{L}\p{Nd}']", ""))


def word_split(phrase: Column | str) -> Column:
    """Words of a phrase: lowered, cut at white space and punctuation but for apostrophes, other marks dropped, outer apostrophes trimmed."""
    return F.filter(F.transform(word_parts(phrase), clean_word), lambda w: w != "")


def trim_quotes(word: Column | str) -> Column:
    return F.regexp_replace(col(word), "^'+|'+$", "")


def sort_letters(text: Column | str) -> Column:
    """The characters in ascending order."""
    return F.array_join(F.array_sort(chars(text)), "")


def anagrams(subject: Column | str, candidates: Column | str) -> Column:
    """The candidates that are other words of the same letters, whatever their case; order and spelling stay."""
    word = F.lower(col(subject))
    key = sort_letters(word)
    return F.filter(col(candidates), lambda c: (F.lower(c) != word) & (sort_letters(F.lower(c)) == key))


def letter_points(letter: Column | str) -> Column:
    """Points of an upper-case character; 1 for any that isn't listed."""
    return F.coalesce(F.try_element_at(lookup(LETTER_POINTS), col(letter)), F.lit(1)).cast("long")


def letter_score(word: Column | str) -> Column:
    return total(F.transform(chars(F.upper(col(word))), letter_points))


def letter_histogram(strand: Column | str, alphabet: str = "ACGT") -> Column:
    """Counts of all letters of the alphabet, 0 included; NULL if any other character occurs."""
    counts = F.create_map(*[x for a in alphabet for x in (F.lit(a), F.regexp_count(col(strand), F.lit(a)).cast("long"))])
    return F.when(col(strand).rlike(f"^[{alphabet}]*$") & ~col(strand).contains("\n"), counts)


def hamming_distance(a: Column | str, b: Column | str) -> Column:
    """Differing bytes of strings of equal length in bytes; NULL for unequal lengths."""
    x, y = (F.split(F.hex(F.encode(col(s), "UTF-8")), "(?<=\\G..)") for s in (a, b))
    n = total(F.zip_with(x, y, lambda p, q: (p != q).cast("long")))
    return F.when(F.octet_length(col(a)) == F.octet_length(col(b)), n)


def is_pangram(text: Column | str) -> Column:
    """All 26 letters occur; characters beyond ASCII don't count."""
    return F.size(F.array_distinct(F.filter(chars(F.lower(col(text))), lambda c: c.rlike("^[a-z]$")))) == 26


def is_isogram(word: Column | str) -> Column:
    """No letter occurs twice, whatever its case."""
    letters = F.filter(chars(F.lower(col(word))), lambda c: c.rlike(r"^\p{L}$"))
    return F.size(letters) == F.size(F.array_distinct(letters))


def reverse_text(text: Column | str) -> Column:
    """By code points."""
    return F.reverse(col(text))


def replace_character(text: Column | str, old: str, new: str) -> Column:
    return F.replace(col(text), F.lit(old), F.lit(new))


# ---- check digits ----------------------------------------------------------------------------------------


def isbn_digit_valid(digit: Column | str, index: Column | int, length: Column | int) -> Column:
    """A digit, or X at the last place."""
    return F.when(col(digit) == "X", num(index) == num(length) - 1).otherwise(col(digit).rlike("^[0-9]$"))


def isbn_digit_value(digit: Column | str) -> Column:
    return F.when(col(digit) == "X", 10).otherwise(col(digit).try_cast("int")).cast("long")


def is_isbn(isbn: Column | str) -> Column:
    """Ten digits but for dashes, the last of which may be a final X, with weighted sum 0 modulo 11."""
    plain = F.replace(col(isbn), F.lit("-"), F.lit(""))
    digits = chars(plain)
    weighted = F.transform(digits, lambda c, i: isbn_digit_value(c) * (10 - i))
    marked = F.transform(digits, lambda c, i: isbn_digit_valid(c, i, F.size(digits)))
    shaped = (F.size(digits) == 10) & F.forall(marked, lambda ok: ok) & ~col(isbn).rlike("X.")
    return F.when(col(isbn).isNotNull(), F.when(shaped, total(weighted) % 11 == 0).otherwise(False))


def remove_white_space(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)\s", "")


def is_luhn(text: Column | str) -> Column:
    """At least two digits, white space apart, passing the Luhn check."""
    plain = remove_white_space(text)
    doubled = F.transform(F.reverse(chars(plain)), lambda c, i: _luhn_digit(c.try_cast("long"), i))
    return F.when(col(text).isNotNull(), F.when(plain.rlike("^[0-9]{2,}$"), total(doubled) % 10 == 0).otherwise(False))


def _luhn_digit(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)


# ---- ciphers -----------------------------------------------------------------------------------------------


def to_rna(dna: Column | str) -> Column:
    """G to C, C to G, T to A, A to U; other characters go."""
    return F.translate(F.regexp_replace(col(dna), "[^GCTA]", ""), "GCTA", "CGAU")


def rotate(text: Column | str, key: int) -> Column:
    """Letters moved by key places, their case kept; any key works."""
    k = key % 26
    return F.translate(col(text), LOWER + UPPER, LOWER[k:] + LOWER[:k] + UPPER[k:] + UPPER[:k])


def _letters(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(text)), "[^a-z]", "")


def shift_text(text: Column | str, distance: int) -> Column:
    """Lowered letters only, moved by distance places."""
    return rotate(_letters(text), distance)


class Shift:
    """A shift cipher; ``new`` gives None for a distance that isn't 1 to 25 or -25 to -1."""

    def __init__(self, distance: int):
        self.distance = distance

    @classmethod
    def new(cls, distance: int) -> Shift | None:
        return cls(distance) if 1 <= abs(distance) <= 25 else None

    @classmethod
    def caesar(cls) -> Shift:
        return cls(3)

    def encode(self, text: Column | str) -> Column:
        return shift_text(text, self.distance)

    def decode(self, text: Column | str) -> Column:
        return shift_text(text, -self.distance)


class Vigenere:
    """A key cipher; ``new`` gives None for a key that is empty, all a, or not all lower-case letters."""

    def __init__(self, key: str):
        self.key = key

    @classmethod
    def new(cls, key: str) -> Vigenere | None:
        return cls(key) if key.strip("a") and set(key) <= set(LOWER) else None

    def _moved(self, text: Column | str, sign: int) -> Column:
        steps = F.array(*[F.lit(sign * LOWER.index(k)) for k in self.key])
        place = lambda c, i: F.pmod(F.ascii(c) - 97 + F.get(steps, i % len(self.key)), F.lit(26))
        return F.array_join(F.transform(chars(_letters(text)), lambda c, i: F.char((place(c, i) + 97).cast("long"))), "")

    def encode(self, text: Column | str) -> Column:
        return self._moved(text, 1)

    def decode(self, text: Column | str) -> Column:
        return self._moved(text, -1)


# ---- numbers as text -------------------------------------------------------------------------------------------


def to_roman(number: Column | str) -> Column:
    """1 to 3999; NULL otherwise."""
    n = col(number)
    places = [F.get(F.array(*map(F.lit, names)), (F.floor(n / 10 ** (3 - k)) % 10).cast("int")) for k, names in enumerate(NUMERALS)]
    return F.when(n.between(1, 3999), F.concat(*places))


def raindrops(number: Column | str) -> Column:
    n = col(number)
    sound = F.concat(*[F.when(n % k == 0, word).otherwise("") for k, word in ((3, "Pling"), (5, "Plang"), (7, "Plong"))])
    return F.when(sound == "", n.cast("string")).otherwise(sound)


def fizz_buzz_line(number: Column | str) -> Column:
    n = col(number)
    return F.when(n % 15 == 0, "FizzBuzz").when(n % 3 == 0, "Fizz").when(n % 5 == 0, "Buzz").otherwise(n.cast("string"))


def fizz_buzz(limit: Column | str) -> Column:
    """Lines 1 to limit, each ended by a line feed; empty below 1."""
    lines = F.transform(F.sequence(long(1), F.greatest(long(1), col(limit).cast("long"))), fizz_buzz_line)
    return F.when(col(limit) >= 1, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).when(col(limit).isNotNull(), "")


def one_decimal(value: Column | str) -> Column:
    """One decimal of the exact binary value, ties to even."""
    x = col(value).cast("double")
    shown = F.call_function("format_number", x, F.lit("0.0"))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").otherwise(shown)


# ---- templates ----------------------------------------------------------------------------------------------------


def welcome_customer(name: Column | str) -> Column:
    return F.concat(F.lit("Welcome to the Tech Palace, "), F.upper(col(name)))


def add_border(message: Column | str, stars: int | Column | str) -> Column:
    """A line of stars above and below; NULL for a negative number."""
    line = F.repeat(F.lit("*"), num(stars).cast("int"))
    return F.when(num(stars) >= 0, F.concat(line, F.lit("\n"), col(message), F.lit("\n"), line))


def clean_message(message: Column | str) -> Column:
    return F.regexp_replace(F.replace(col(message), F.lit("*"), F.lit("")), r"(?U)^\s+|\s+$", "")


def others_name(name: Column | str) -> Column:
    return F.when(col(name) == "", "you").otherwise(col(name))


def two_for(name: Column | str) -> Column:
    return F.format_string("One for %s, one for me.", others_name(name))


def greet(name: Column | str, language: str) -> Column:
    return F.format_string(GREETINGS[language], col(name))


def say_hello(name: Column | str, language: str) -> Column:
    return F.concat(F.lit(f"I can speak {language}: "), greet(name, language))


def hello_world() -> Column:
    return F.lit("Hello, World!")


def welcome_guest(name: Column | str) -> Column:
    return F.format_string("Welcome to my party, %s!", col(name))


def happy_birthday(name: Column | str, age: Column | str) -> Column:
    return F.format_string("Happy birthday %s! You are now %d years old!", col(name), col(age).cast("long"))


def assign_table(name: Column | str, table: Column | str, neighbor: Column | str, direction: Column | str, distance: Column | str) -> Column:
    first = F.format_string("\nYou have been assigned to table %03d. Your table is %s, exactly ", col(table).cast("long"), col(direction))
    return F.concat(welcome_guest(name), first, one_decimal(col(distance).cast("double")), F.format_string(" meters from here.\nYou will be sitting next to %s.", col(neighbor)))


def temperature_unit(unit: Column | str) -> Column:
    return F.get(F.array(*map(F.lit, TEMPERATURE_UNITS)), col(unit).cast("int"))


def speed_unit(unit: Column | str) -> Column:
    return F.get(F.array(*map(F.lit, SPEED_UNITS)), col(unit).cast("int"))


def show_temperature(t: Column | str) -> Column:
    """Of a struct (degree, unit)."""
    return F.concat(col(t)["degree"].cast("string"), F.lit(" "), temperature_unit(col(t)["unit"]))


def show_speed(s: Column | str) -> Column:
    """Of a struct (magnitude, unit)."""
    return F.concat(col(s)["magnitude"].cast("string"), F.lit(" "), speed_unit(col(s)["unit"]))


def show_weather(w: Column | str) -> Column:
    """Of a struct (location, temperature, wind_direction, wind_speed, humidity)."""
    w = col(w)
    return F.concat(w["location"], F.lit(": "), show_temperature(w["temperature"]), F.lit(", Wind "), w["wind_direction"], F.lit(" at "), show_speed(w["wind_speed"]), F.lit(", "), w["humidity"].cast("string"), F.lit("% Humidity"))


def show_result(name: Column | str, votes: Column | str) -> Column:
    return F.format_string("%s (%d)", col(name), col(votes).cast("long"))


def show_distance(distance: Column | str) -> Column:
    return F.format_string("Driven %d meters", col(distance).cast("long"))


def show_battery(battery: Column | str) -> Column:
    return F.format_string("Battery at %d%%", col(battery).cast("long"))


def describe_number(number: Column | str) -> Column:
    return F.concat(F.lit("This is the number "), one_decimal(col(number).cast("double")))


def describe_box(number: Column | str) -> Column:
    return F.concat(F.lit("This is a box containing the number "), one_decimal(col(number).cast("double")))


def fancy_value(box: Column | str) -> Column:
    """The text in a fancy box, a struct with the field s."""
    return col(box)["s"]


def extract_fancy(kind: Column | str, value: Column | str) -> Column:
    """The whole number in a fancy box; 0 for other kinds and texts."""
    number = F.when(col(value).rlike("^[+-]?[0-9]+$") & ~col(value).contains("\n"), col(value)).try_cast("long")
    return F.when(col(kind) == "fancy", F.coalesce(number, long(0))).otherwise(long(0))


def describe_fancy(kind: Column | str, value: Column | str) -> Column:
    return F.concat(F.lit("This is a fancy box containing the number "), one_decimal(extract_fancy(kind, value).cast("double")))


def describe_anything(thing: Column | str) -> Column:
    """Of a struct (kind, d, s): kinds int, float, box, fancy and other_fancy; anything else returns to sender."""
    t = col(thing)
    fancy = t["kind"].isin("fancy", "other_fancy")
    shown = one_decimal(F.when(fancy, extract_fancy(t["kind"], t["s"]).cast("double")).otherwise(t["d"].cast("double")))
    said = F.when(t["kind"].isin("int", "float"), "This is the number ").when(t["kind"] == "box", "This is a box containing the number ").when(fancy, "This is a fancy box containing the number ")
    return F.coalesce(F.concat(said, shown), F.lit("Return to sender"))
