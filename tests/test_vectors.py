"""Fixed input and output pairs of every operation, as small tables."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brindle.functions import arrays, bits, decisions, numeric, text
from brindle.operators import iterative, relational, sampling, sets, stateful
from brindle.plans import catalogue, demo
from brindle.sources import demo_books


def values(spark, schema, rows, *columns):
    """One tuple of results per row."""
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def pairs(spark, schema, cases, column):
    assert values(spark, schema, [c[0] for c in cases], column) == [c[1] for c in cases]


def test_words(spark):
    df = spark.createDataFrame([(1, "car: carpet as java: javascript!!&@$%^&"), (2, "'First: don't laugh. Then: don't cry.'"), (3, ",\n,one,\n ,two \n 'three'"), (4, ""), (5, "a$b A'B ''x''"), (6, "Joe can't tell between 'large' and large.")], "id int, t string")
    got = {}
    for r in relational.word_counts(df, "t", ["id"]).collect():
        got.setdefault(r.id, {})[r.word] = r.n
    assert got[1] == dict.fromkeys(["car", "carpet", "as", "java", "javascript"], 1)
    assert got[2] == {"first": 1, "don't": 2, "laugh": 1, "then": 1, "cry": 1}
    assert got[3] == {"one": 1, "two": 1, "three": 1} and 4 not in got
    assert got[5] == {"ab": 1, "a'b": 1, "x": 1}
    assert got[6] == {"joe": 1, "can't": 1, "tell": 1, "between": 1, "large": 2, "and": 1}


def test_keep_and_discard_make_up_the_input(spark):
    rows = [(i, rnd if rnd % 3 else None) for i, rnd in enumerate(random.Random(3).choices(range(20), k=60))]
    df = spark.createDataFrame(rows, "id int, v int")
    kept, gone = relational.keep(df, F.col("v") > 9), relational.discard(df, F.col("v") > 9)
    assert sorted(map(tuple, kept.collect() + gone.collect())) == sorted(rows) and kept.where("v is null").count() == 0
    odd, z = lambda x: x % 2 == 1, lambda x: x.startswith("z")
    assert values(spark, "a array<bigint>", [([1, 2, 3],), ([],)], arrays.keep("a", odd), arrays.discard("a", odd)) == [([1, 3], [2]), ([], [])]
    assert values(spark, "a array<string>", [(["apple", "zebra", "zoo", None],)], arrays.keep("a", z), arrays.discard("a", z)) == [(["zebra", "zoo"], ["apple", None])]
    has_5 = lambda x: F.array_contains(x, 5)
    assert values(spark, "a array<array<bigint>>", [([[1, 5], [2], [5]],)], arrays.keep("a", has_5)) == [[[1, 5], [5]]]


def test_anagrams(spark):
    cases = [(("BANANA", ["BANANA", "banana", "Banana"]), []), (("LISTEN", ["enlists", "google", "banana", "Silent"]), ["Silent"]), (("ΑΒΓ", ["ΒΓΑ", "ΒΓΔ", "γβα", "αβγ"]), ["ΒΓΑ", "γβα"]), (("solemn", ["lemons", "cherry", "melons"]), ["lemons", "melons"]), (("tapper", ["patter"]), []), (("go", ["go Go GO"]), [])]
    pairs(spark, "s string, c array<string>", cases, text.anagrams("s", "c"))
    pairs(spark, "s string", [("cab", "abc"), ("", ""), ("b😀a", "ab😀")], text.sort_letters("s"))


def test_texts(spark):
    pairs(spark, "s string", [("Hello, 世界", "界世 ,olleH"), ("", "")], text.reverse_text("s"))
    pairs(spark, "s string", [("the quick brown fox jumps over the lazy dog", True), ("abcdefghijklm ABCDEFGHIJKLM", False), ("", False), ('"Five quacking Zephyrs jolt my wax bed."', True), ("the 1 quick brown fox jumps over the 2 lazy dogs é", True)], text.is_pangram("s"))
    pairs(spark, "s string", [("", True), ("isogram", True), ("eleven", False), ("six-year-old", True), ("Alphabet", False), ("up-to-date", False)], text.is_isogram("s"))
    pairs(spark, "s string", [("OxyphenButazone", 41), ("abcdefghijklmnopqrstuvwxyz", 87), ("", 0), ("a", 1), ("quirky", 22), ("a 1", 3)], text.letter_score("s"))
    pairs(spark, "s string", [("3-598-21508-8", True), ("3-598-21508-9", False), ("3-598-21507-X", True), ("3-598-2X507-9", False), ("3598215078X", False), ("98245726788", False), ("3-598-21507-A", False), ("", False), ("359821507", False), ("3-598-21507-X-", False), ("00", False), ("134456729", False)], text.is_isbn("s"))
    pairs(spark, "s string", [("1", False), ("0", False), ("059", True), ("59", True), ("055 444 285", True), ("055 444 286", False), ("8273 1232 7352 0569", False), ("0000 0", True), (":9", False), (" 0", False), ("055-444-285", False), ("234 567 891 234", True), ("091", True), ("059a", False)], text.is_luhn("s"))
    pairs(spark, "s string", [("ACGTGGTCTTAA", "UGCACCAGAAUU"), ("", ""), ("GXC", "CG")], text.to_rna("s"))
    pairs(spark, "a string, b string", [(("GGACGGATTCTG", "AGGACGGATTCT"), 9), (("", ""), 0), (("AATG", "AAA"), None), (("é", "e"), None), (("é", "ab"), 2)], text.hamming_distance("a", "b"))
    pairs(spark, "s string", [("", {"A": 0, "C": 0, "G": 0, "T": 0}), ("GGGG", {"A": 0, "C": 0, "G": 4, "T": 0}), ("AGXXACT", None), ("acgt", None)], text.letter_histogram("s"))
    pairs(spark, "s string", [("❗ recommended 🔍", "recommendation"), ("🔍 … ❗", "search"), ("☀ fine", "weather"), ("none", "default")], decisions.log_application("s"))
    pairs(spark, "s string", [("exercism🔍", True), ("exercism❗!", False)], decisions.within_limit("s", 9))
    pairs(spark, "s string", [("please replace '👎' with '👍'", "please replace '👍' with '👍'")], text.replace_character("s", "👎", "👍"))
    pairs(spark, "s string", [("*****\n SALE\n*****", "SALE"), (" *x y*\t", "x y")], text.clean_message("s"))
    pairs(spark, "s string", [("", "One for you, one for me."), ("Alice", "One for Alice, one for me."), ("Zaphod", "One for Zaphod, one for me.")], text.two_for("s"))
    pairs(spark, "s string", [("Flora", "I can speak Italian: Ciao Flora!")], text.say_hello("s", "Italian"))
    pairs(spark, "s string", [("Flora", "I can speak Portuguese: Olá Flora!")], text.say_hello("s", "Portuguese"))
    pairs(spark, "s string", [("Judy", "Welcome to the Tech Palace, JUDY")], text.welcome_customer("s"))
    pairs(spark, "s string, n int", [(("Hi", 3), "***\nHi\n***"), (("Hi", 0), "\nHi\n"), (("Hi", -1), None)], text.add_border("s", "n"))
    seat = "Welcome to my party, Christiane!\nYou have been assigned to table 022. Your table is on the left, exactly 9.2 meters from here.\nYou will be sitting next to Frank."
    pairs(spark, "n string, t int, o string, w string, d double", [(("Christiane", 22, "Frank", "on the left", 9.2394381), seat)], text.assign_table("n", "t", "o", "w", "d"))
    assert values(spark, "x double", [0.25, 0.35, None, -2.5], text.one_decimal("x")) == ["0.2", "0.3", None, "-2.5"]
    w = ("Athens", (21, 0), "N", (16, 0), 63)
    pairs(spark, "w struct<location:string,temperature:struct<degree:bigint,unit:int>,wind_direction:string,wind_speed:struct<magnitude:bigint,unit:int>,humidity:bigint>", [((w,), "Athens: 21 °C, Wind N at 16 km/h, 63% Humidity")], text.show_weather("w"))
    assert values(spark, "u int", [0, 1, 2], text.temperature_unit("u"), text.speed_unit("u")) == [("°C", "km/h"), ("°F", "mph"), (None, None)]
    box = "kind string, d double, s string"
    cases = [(("int", 7.0, None), "This is the number 7.0"), (("float", -1.25, None), "This is the number -1.2"), (("box", 6.0, None), "This is a box containing the number 6.0"), (("fancy", None, "10"), "This is a fancy box containing the number 10.0"), (("fancy", None, " 10"), "This is a fancy box containing the number 0.0"), (("other_fancy", None, "9"), "This is a fancy box containing the number 0.0"), (("letter", None, "some string"), "Return to sender")]
    pairs(spark, box, cases, text.describe_anything(F.struct("kind", "d", "s")))


def test_ciphers(spark):
    pairs(spark, "s string", [("Let's eat, Grandma!", "Gzo'n zvo, Bmviyhv!")], text.rotate("s", 21))
    pairs(spark, "s string", [("a", "z")], text.rotate("s", -1))
    pairs(spark, "s string", [("iamapandabear", "ldpdsdqgdehdu"), ("Go, go, gophers", "jrjrjrskhuv"), ("I am a panda bear.", "ldpdsdqgdehdu")], text.Shift.caesar().encode("s"))
    pairs(spark, "s string", [("ATTACKATDAWN", "lxfopvefrnhr")], text.Vigenere.new("lemon").encode("s"))
    assert all(text.Shift.new(d) is None for d in (-27, -26, 0, 26, 27)) and text.Shift.new(-3) and text.Shift.new(25)
    assert all(text.Vigenere.new(k) is None for k in ("", "a", "aa", "no way", "CAT", "3", "and,")) and text.Vigenere.new("abc")
    for cipher in (text.Shift.new(-7), text.Vigenere.new("lemon")):
        pairs(spark, "s string", [("Zebra, über 9 Äpfel!", "zebraberpfel")], cipher.decode(cipher.encode("s")))


def test_decisions(spark):
    cases = [(("ace", "ace", "jack"), "P"), (("ace", "jack", "ace"), "S"), (("ace", "king", "nine"), "W"), (("six", "ten", "seven"), "H"), (("six", "ten", "six"), "S"), (("two", "three", "two"), "H"), (("ten", "ten", "ace"), "S"), (("ace", "queen", "ten"), "S"), (("x", "y", "z"), "H")]
    pairs(spark, "a string, b string, d string", cases, decisions.first_turn("a", "b", "d"))
    nan = math.nan
    pairs(spark, "p double, a double", [((1000.0, 3.0), 700.0), ((1000.0, 2.9), 800.0), ((1000.0, 10.0), 500.0), ((1000.0, nan), 700.0)], decisions.resell_price("p", "a"))
    pairs(spark, "a double, b double, c double", [((1.0, 1.0, 3.0), 0), ((0.4, 0.6, 0.3), 3), ((1.0, 1.0, 2.0), 2), ((2.0, 2.0, 2.0), 1), ((0.0, 0.0, 0.0), 0), ((nan, nan, nan), 0), ((5.0, 4.0, 5.0), 2)], decisions.triangle_kind("a", "b", "c"))
    pairs(spark, "x double, y double", [((0.0, 10.0), 1), ((0.8, -0.8), 5), ((0.0, 0.0), 10), ((-9.0, 9.0), 0), ((0.7, 0.7), 10), ((nan, 1.0), 0)], decisions.ring_score("x", "y"))
    pairs(spark, "y bigint", [(1900, False), (2000, True), (1996, True), (2015, False), (1800, False), (2400, True)], decisions.is_leap_year("y"))
    pairs(spark, "b double", [(999.9999, 0.5), (0.0, 0.5), (-1.0, 3.213), (1000.0, 1.621), (5000.0, 2.475)], F.round(decisions.interest_rate("b").cast("double"), 5))
    pairs(spark, "a string, b string", [(("Bugatti Veyron", "Ford Pinto"), "Bugatti Veyron is clearly the better choice.")], decisions.choose_vehicle("a", "b"))
    pairs(spark, "k string", [("car", True), ("truck", True), ("Car", False), (None, False)], decisions.needs_license("k"))
    for k in (True, False):
        for a in (True, False):
            for p in (True, False):
                for d in (True, False):
                    got = values(spark, "k boolean, a boolean, p boolean, d boolean", [(k, a, p, d)], decisions.can_fast_attack("k"), decisions.can_spy("k", "a", "p"), decisions.can_signal_prisoner("a", "p"), decisions.can_free_prisoner("k", "a", "p", "d"))
                    assert got == [(not k, k or a or p, not a and p, (d and not a) or (p and not k and not a))]


def test_arrays(spark):
    days = [2, 5, 0, 7, 4, 1, 3, 0, 2, 5, 0, 1, 3, 7]
    assert values(spark, "a array<bigint>", [(days,)], arrays.week_total("a", 1), arrays.week_total("a", 2), arrays.week_total("a", 3), arrays.week_total("a", 0), arrays.series_total("a")) == [(22, 18, 0, 0, 40)]
    pairs(spark, "a array<bigint>", [(([4, 2],), [5, 2]), (([],), [])], arrays.fix_alternate("a"))
    cards = [([5, 2, 10, 6, 8, 7, 0, 9],)]
    assert values(spark, "a array<bigint>", cards, arrays.get_item("a", 4), arrays.get_item("a", 9), arrays.get_item("a", -1)) == [(8, -1, -1)]
    assert values(spark, "a array<bigint>", [([1, 2],)], arrays.set_item("a", 0, 6), arrays.set_item("a", -1, 6), arrays.set_item("a", 2, 6), arrays.remove_item("a", 1), arrays.remove_item("a", 7), arrays.prepend_items("a", F.array(F.lit(9)))) == [([6, 2], [1, 2, 6], [1, 2, 6], [1], [1, 2], [9, 1, 2])]
    for digits, span, want in [("29", 2, 18), ("0123456789", 2, 72), ("73167176531330624919225119674426574742355349194934", 6, 23520), ("99099", 3, 0), ("123", 4, None), ("", 0, 0), ("123", 0, 1), ("1234a5", 2, None), ("12345", -1, None), ("9" * 25, 25, 9**25)]:
        pairs(spark, "s string", [(digits, want)], arrays.largest_product("s", span))
    pairs(spark, "a array<string>", [((["brown", "black"],), 10), ((["green", "brown", "orange"],), 51), ((["black", "brown"],), 1), ((["pink", "brown"],), 1), ((["red"],), 0)], arrays.colour_value("a"))
    pairs(spark, "s string", [("black", 0), ("white", 9), ("pink", -1), ("Black", -1)], arrays.colour_code("s"))
    got = values(spark, "a array<string>", [(["sauce", "Noodles", "sauce", "meat"],)], arrays.layer_quantities("a"), arrays.layers_time("a", 0), arrays.layers_time("a", 3))
    assert (tuple(got[0][0]), *got[0][1:]) == ((50, 0.4), 8, 12)
    assert values(spark, "f array<string>, m array<string>", [(["a", "b"], ["x", "?"]), ([], ["x"])], arrays.add_secret_ingredient("f", "m")) == [["x", "b"], None]
    assert values(spark, "q array<double>", [([0.5, 250.0],)], arrays.scale_recipe("q", 6)) == [[1.5, 750.0]]
    board = {"A": [True, False, True], "B": [False] * 8, "C": [True] * 8}
    assert values(spark, "b map<string,array<boolean>>", [(board,)], arrays.count_in_file("b", "A"), arrays.count_in_file("b", "Z"), arrays.count_in_rank("b", 3), arrays.count_in_rank("b", 8), arrays.count_in_rank("b", 100), arrays.count_squares("b"), arrays.count_occupied("b")) == [(2, 0, 2, 1, 0, 19, 10)]
    inverted = relational.invert_map(spark.createDataFrame([(1, ["A", "E"]), (2, ["D", "a"])], "k int, v array<string>"), "k", "v")
    assert {r.letter: r.score for r in inverted.collect()} == {"a": 2, "e": 1, "d": 2}


def test_numbers(spark):
    pairs(spark, "n bigint", [(1000000, 152), (1, 0), (16, 4), (12, 9), (0, None), (-15, None), (None, None)], numeric.collatz_steps("n"))
    pairs(spark, "n bigint", [(0, "Error with value 0: Input must be greater than zero"), (3, None)], numeric.collatz_error("n"))
    pairs(spark, "n bigint", [(1, []), (8, [2, 2, 2]), (901255, [5, 17, 23, 461]), (93819012551, [11, 9539, 894119]), (0, None), (2**61 - 1, [2**61 - 1]), (3037000493**2, [3037000493] * 2), (9223372036854775783, [9223372036854775783])], numeric.prime_factors("n"))
    assert [r.prime for r in iterative.sieve(spark, 13).orderBy("prime").collect()] == [2, 3, 5, 7, 11, 13] and iterative.sieve(spark, 1).count() == 0 and iterative.sieve(spark, 1000).count() == 168
    pairs(spark, "n bigint", [(3999, "MMMCMXCIX"), (48, "XLVIII"), (1024, "MXXIV"), (0, None), (-1, None), (4000, None)], text.to_roman("n"))
    pairs(spark, "n bigint", [(105, "PlingPlangPlong"), (1, "1"), (0, "PlingPlangPlong"), (28, "Plong")], text.raindrops("n"))
    pairs(spark, "n bigint", [(5, "1\n2\nFizz\n4\nBuzz\n"), (0, ""), (-3, "")], text.fizz_buzz("n"))
    lines = iterative.fizz_buzz_lines(spark.createDataFrame([(15,), (5,), (4,), (0,), (None,)], "n bigint"), "n")
    assert {r.n: r.line for r in lines.collect()} == {15: "FizzBuzz", 5: "Buzz", 4: "4", 0: None, None: None}
    assert values(spark, "n bigint", [100, 10, 1], numeric.square_of_sum("n"), numeric.sum_of_squares("n"), numeric.squares_difference("n")) == [(25502500, 338350, 25164150), (3025, 385, 2640), (1, 1, 0)]
    pairs(spark, "b double, t double", [((100.0, 125.80), 47), ((1000.0, 1100.0), 6), ((8080.80, 9090.90), 5), ((2345.67, 12345.6789), 85), ((12.0, 1.0), 0), ((0.0, 1.0), None), ((-5.0, 1.0), None), ((-5.0, -6.0), 0)], numeric.years_to_target("b", "t"))
    assert values(spark, "r bigint, s double", [(426, 80.0), (6824, 20.5)], numeric.cars_per_hour("r", "s"), numeric.cars_per_minute("r", "s")) == [(340.8, 5), (1398.92, 23)]
    pairs(spark, "n bigint", [(148, 1410000), (0, 0), (37, 355000), (10, 95000)], numeric.cars_cost("n"))
    assert values(spark, "n bigint, m bigint", [(3, 25)], numeric.oven_time_left("m"), numeric.layering_time("n"), numeric.elapsed_time("n", "m")) == [(15, 6, 31)]
    pairs(spark, "t timestamp_ntz", [((datetime(2011, 4, 25),), datetime(2043, 1, 1, 1, 46, 40))], numeric.add_gigasecond("t"))


def test_sets(spark):
    df = spark.createDataFrame([(p,) for p in (1, 2, 3, 10, 99, 99, 63, 64, 1000, -5)], "p bigint")
    held = sets.BitSet.of(df, "p", size=100)
    assert held.count().first()[0] == 7 and bits.capacity(100) == 128
    probe = spark.createDataFrame([(p,) for p in (10, 50, 99, 63, 127, 128, -1)], "p bigint")
    assert [r.there for r in held.test(probe, "p").orderBy("p").collect()] == [None, True, False, True, True, False, None]
    assert held.cleared(spark.createDataFrame([(10,), (63,), (55,)], "p bigint"), "p").count().first()[0] == 5
    assert sets.BitSet.of(df.limit(0), "p").count().first()[0] == 0
    want = {"apple": (23, 167), "banana": (714, 552), "grape": (762, 840), "orange": (839, 59), "pineapple": (641, 849)}
    assert values(spark, "s string", list(want), bits.fnv1("s") % 1000, bits.fnv1a("s") % 1000) == list(want.values())
    words = spark.createDataFrame([(w,) for w in want], "s string")
    for m in (1000, 1 << 17):
        bloom = sets.BloomFilter(m, [bits.fnv1, bits.fnv1a])
        got = bloom.contains(words, "s", bloom.of(words.where("s in ('apple', 'banana')"), "s"))
        assert {r.s for r in got.where("maybe").collect()} == {"apple", "banana"} and got.count() == 5
        assert bloom.contains(words, "s", bloom.of(words, "s")).where("maybe").count() == 5
    for m, hashes in ((0, [bits.fnv1]), (-1, [bits.fnv1]), (10, [])):
        with pytest.raises(ValueError):
            sets.BloomFilter(m, hashes)


def test_state(spark):
    ops = [("add", "peas", "dozen"), ("add", "peas", "half_of_a_dozen"), ("remove", "peas", "gross"), ("remove", "carrot", "dozen"), ("add", "x", "crate"), ("add", "x", "gross"), ("remove", "x", "gross"), ("remove", "peas", "crate")]
    df = spark.createDataFrame([(1, i, *o) for i, o in enumerate(ops)] + [(2, 0, "remove", "a", "dozen")], "k int, i int, op string, item string, unit string")
    got = {r.k: (r.bill, r.accepted) for r in stateful.bills(df, "k", ["i"]).collect()}
    assert got == {1: ({"peas": 18}, 4), 2: ({}, 0)}
    q = arrays.bill_quantity("m", "peas")
    assert values(spark, "m map<string,bigint>", [({"peas": 3},), ({},)], q["quantity"], q["there"]) == [(3, True), (0, False)]
    items = spark.createDataFrame([("a", "dozen"), ("a", "gross"), ("b", "crate")], "item string, unit string")
    assert [tuple(r) for r in relational.bill_totals(items).collect()] == [("a", 156)] and [tuple(r) for r in relational.unknown_units(items).collect()] == [("b", "crate")]
    assert values(spark, "m map<string,bigint>", [({"Mary": 10},), ({},)], stateful.decrement_votes("m", "Mary")) == [{"Mary": 9}, {"Mary": -1}]
    assert values(spark, "v bigint", [None, 3], stateful.vote_count("v"), stateful.increment_votes("v", 2)) == [(0, None), (3, 5)]
    car = stateful.new_car("s", "d")
    got = values(spark, "s bigint, d bigint, n bigint", [(5, 100, 1), (5, 50, 9), (3, 0, 4), (2, 7, 200), (2, -1, 3)], stateful.drive(car, F.col("n")), stateful.drive(car, F.col("n"), spare=False))
    step = lambda battery, distance, speed, drain, spare: (battery - drain, distance + speed) if (battery > drain if spare else battery >= drain) else (battery, distance)
    for (s, d, n), row in zip([(5, 100, 1), (5, 50, 9), (3, 0, 4), (2, 7, 200), (2, -1, 3)], got):
        for spare, out in zip((True, False), row):
            state = (100, 0)
            for _ in range(n):
                state = step(*state, s, d, spare)
            assert (out["battery"], out["distance"]) == state, (s, d, n, spare)
    race = "s bigint, d bigint, b bigint, t bigint"
    assert values(spark, race, [(3, 5, 100, 61), (3, 5, 100, 60), (3, 0, 100, 5), (0, 5, 100, 5), (20, 2, 55, 678)], decisions.can_finish_strict("s", "d", "b", "t"), decisions.can_finish_floored("s", "d", "b", "t")) == [(False, True), (True, True), (None, True), (False, None), (False, False)]
    assert values(spark, "n bigint", [1, 0], stateful.sell_one("n")["in_stock"], stateful.sell_one("n")["error"]) == [(0, None), (0, "out_of_stock")]
    stock = spark.createDataFrame([("a", 2), ("b", 5), ("c", 0)], "t string, n bigint")
    sales = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("z",)], "t string")
    assert sorted(map(tuple, relational.sell(stock, sales, "t", "n").collect())) == [("a", 0, 2, 1), ("b", 4, 1, 0), ("c", 0, 0, 0)]


def test_book_store(spark):
    store = demo_books(spark)
    assert float(relational.inventory_value(store, "price", "in_stock").first()[0]) == pytest.approx(39.99 * 5 + 29.99 * 3 + 24.99 * 2)
    assert float(relational.inventory_value(relational.new_book_store(spark), "price", "in_stock").first()[0]) == 0
    assert relational.find_containing(store, "title", "Go").count() == 3 and relational.find_containing(store, "title", "").count() == 3
    assert relational.find_first(store, F.col("title") == "none", "ins_seq").count() == 0
    more = relational.add_books(store, [relational.new_book("Learning Go", "someone", 1.0, 1)])
    assert relational.find_first(more, F.col("title") == "Learning Go", "ins_seq").first().author == "Jon Bodner"
    assert demo.books(spark)[0] == "Total inventory value: $339.90" and len(demo.books(spark)) == 5


def test_random(spark):
    rows = catalogue.dice(spark, "/root/testdata/sf0.001").collect()
    assert {r.die for r in rows} == set(range(1, 21)) and all(0 <= r.energy < 12 for r in rows)
    assert all(sorted(r.animals) == sorted(sampling.ANIMALS) for r in rows) and len({tuple(r.animals) for r in rows}) > 500
    for target in (1, 42, 100):
        assert iterative.guess_trace(target, 3)[-1] == target
    with pytest.raises(ValueError):
        iterative.guess_trace(101, 1)


def test_tumbling_needs_whole_weeks(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(15)] + [(2, i, 1.0) for i in range(6)], "k int, t int, v double")
    assert sorted((r.k, r.week, float(r.total)) for r in relational.tumbling_totals(df, "k", ["t"], "v").collect()) == [(1, 1, 21.0), (1, 2, 70.0)]
