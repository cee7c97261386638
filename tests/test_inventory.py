"""Every operation of the inventory is one function, and the registered queries really call it."""

import functools
import importlib
import sys

from brindle.plans import catalogue
from brindle.plans import demo  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
FUNCTIONS = {
    "operators.relational.keep": (1,),
    "operators.relational.discard": (2,),
    "operators.relational.find_first": (3,),
    "operators.relational.find_containing": (4,),
    "operators.relational.add_books": (5,),
    "operators.relational.new_book_store": (6,),
    "operators.relational.new_book": (7,),
    "functions.decisions.has_stock": (8,),
    "operators.relational.anagram_pairs": (9,),
    "functions.text.sort_letters": (10,),
    "operators.relational.inventory_value": (11,),
    "operators.relational.total_by": (12,),
    "operators.relational.word_counts": (13,),
    "functions.text.clean_word": (14,),
    "functions.text.letter_histogram": (15,),
    "functions.arrays.count_in_file": (16,),
    "functions.arrays.count_in_rank": (17,),
    "functions.arrays.count_squares": (18,),
    "functions.arrays.count_occupied": (19,),
    "functions.arrays.layer_quantities": (20,),
    "functions.text.letter_score": (21,),
    "functions.text.letter_points": (22,),
    "functions.text.hamming_distance": (23,),
    "operators.relational.tumbling_totals": (24,),
    "operators.relational.fix_alternate": (25,),
    "functions.arrays.largest_product": (26,),
    "functions.arrays.favourite_cards": (27,),
    "functions.arrays.get_item": (28,),
    "functions.arrays.set_item": (29,),
    "functions.arrays.prepend_items": (30,),
    "functions.arrays.remove_item": (31,),
    "operators.relational.invert_map": (32,),
    "operators.relational.units_table": (33,),
    "functions.arrays.new_bill": (34,),
    "operators.relational.bill_totals": (35,),
    "operators.stateful.bill_lines": (36,),
    "functions.arrays.bill_quantity": (37,),
    "functions.arrays.colours": (38,),
    "functions.arrays.colour_code": (39,),
    "functions.arrays.colour_value": (40,),
    "functions.arrays.layers_time": (41,),
    "functions.arrays.add_secret_ingredient": (42,),
    "functions.arrays.scale_recipe": (43,),
    "functions.decisions.can_fast_attack": (44,),
    "functions.decisions.can_spy": (45,),
    "functions.decisions.can_signal_prisoner": (46,),
    "functions.decisions.can_free_prisoner": (47,),
    "functions.decisions.card_value": (48,),
    "functions.decisions.first_turn": (49,),
    "functions.decisions.needs_license": (50,),
    "functions.decisions.choose_vehicle": (51,),
    "functions.decisions.resell_price": (52,),
    "functions.decisions.triangle_kind": (53,),
    "functions.decisions.is_triangle": (54,),
    "functions.decisions.all_equal": (55,),
    "functions.decisions.any_two_equal": (56,),
    "functions.decisions.ring_score": (57,),
    "functions.decisions.distance_from_center": (58,),
    "functions.decisions.interest_rate": (59,),
    "functions.decisions.is_leap_year": (60,),
    "functions.decisions.log_application": (61,),
    "functions.decisions.within_limit": (62,),
    "functions.text.replace_character": (63,),
    "functions.text.reverse_text": (64,),
    "functions.text.is_pangram": (65,),
    "functions.text.is_isogram": (66,),
    "functions.text.is_isbn": (67,),
    "functions.text.isbn_digit_valid": (68,),
    "functions.text.isbn_digit_value": (69,),
    "functions.text.is_luhn": (70,),
    "functions.text.remove_white_space": (71,),
    "functions.text.to_rna": (72,),
    "functions.text.rotate": (73,),
    "functions.text.Shift.caesar": (74,),
    "functions.text.Shift.new": (75,),
    "functions.text.Vigenere.new": (76,),
    "functions.text.Shift.encode": (77,),
    "functions.text.Shift.decode": (78,),
    "functions.text.shift_text": (79,),
    "functions.text.Vigenere.encode": (80,),
    "functions.text.Vigenere.decode": (81,),
    "functions.text.to_roman": (82,),
    "functions.text.raindrops": (83,),
    "functions.text.welcome_customer": (84,),
    "functions.text.add_border": (85,),
    "functions.text.clean_message": (86,),
    "functions.text.two_for": (87,),
    "functions.text.others_name": (88,),
    "functions.text.say_hello": (89,),
    "functions.text.greet": (90, 91, 92, 93),
    "functions.text.hello_world": (94,),
    "functions.text.welcome_guest": (95,),
    "functions.text.happy_birthday": (96,),
    "functions.text.assign_table": (97,),
    "functions.text.temperature_unit": (98,),
    "functions.text.show_temperature": (99,),
    "functions.text.speed_unit": (100,),
    "functions.text.show_speed": (101,),
    "functions.text.show_weather": (102,),
    "functions.text.show_result": (103,),
    "functions.text.show_distance": (104,),
    "functions.text.show_battery": (105,),
    "functions.text.describe_number": (106,),
    "functions.text.describe_box": (107,),
    "functions.text.fancy_value": (108,),
    "functions.text.extract_fancy": (109,),
    "functions.text.describe_fancy": (110,),
    "functions.text.describe_anything": (111,),
    "functions.numeric.cars_per_hour": (112,),
    "functions.numeric.cars_per_minute": (113,),
    "functions.numeric.cars_cost": (114,),
    "functions.numeric.square_of_sum": (115,),
    "functions.numeric.sum_of_squares": (116,),
    "functions.numeric.squares_difference": (117,),
    "functions.numeric.collatz_steps": (118,),
    "functions.numeric.collatz_error": (119,),
    "functions.numeric.prime_factors": (120,),
    "operators.iterative.sieve": (121,),
    "operators.iterative.fizz_buzz_lines": (122,),
    "functions.numeric.interest": (123,),
    "functions.numeric.annual_balance": (124,),
    "functions.numeric.years_to_target": (125,),
    "functions.numeric.oven_time_left": (126,),
    "functions.numeric.layering_time": (127,),
    "functions.numeric.elapsed_time": (128,),
    "functions.numeric.add_gigasecond": (129,),
    "operators.sets.BitSet.of": (130, 131),
    "operators.sets.BitSet.cleared": (132,),
    "operators.sets.BitSet.test": (133,),
    "operators.sets.BitSet.count": (134,),
    "operators.sets.BloomFilter.__init__": (135,),
    "operators.sets.BloomFilter.of": (136,),
    "operators.sets.BloomFilter.contains": (137,),
    "operators.sampling.roll_die": (138,),
    "operators.sampling.wand_energy": (139,),
    "operators.sampling.shuffled_animals": (140,),
    "operators.stateful.sell_one": (141,),
    "operators.stateful.vote_counter": (142,),
    "operators.stateful.vote_count": (143,),
    "operators.stateful.increment_votes": (144,),
    "operators.stateful.election_result": (145,),
    "operators.stateful.decrement_votes": (146,),
    "operators.stateful.new_car": (147, 150),
    "operators.stateful.drive": (148, 152),
    "functions.decisions.can_finish_strict": (149,),
    "operators.stateful.new_track": (151,),
    "functions.decisions.can_finish_floored": (153,),
    "plans.demo.books": (154,),
    "operators.iterative.guesses": (155,),
    "plans.demo.main": (156,),
}
#: What the demonstration programs call themselves, outside the catalogue.
PROGRAMS = {154, 156}


def resolve(name):
    parts = name.split(".")
    found = importlib.import_module("brindle." + ".".join(parts[:2]))
    return functools.reduce(getattr, parts[2:], found)


def test_every_number_has_a_function():
    numbers = sorted(n for v in FUNCTIONS.values() for n in v)
    assert numbers == list(range(1, 157)) and all(callable(resolve(f)) for f in FUNCTIONS)


def test_queries_call_what_they_cover(spark, monkeypatch):
    called, seen = set(), set()
    for name in FUNCTIONS:
        f = resolve(name)
        if hasattr(f, "evalType"):  # a vectorised function: what runs here is its wrapper
            module, short = importlib.import_module("brindle." + ".".join(name.split(".")[:2])), name.rsplit(".", 1)[1]
            monkeypatch.setattr(module, short, functools.partial(lambda name, f, *a: called.add(name) or f(*a), name, f))
    sys.setprofile(lambda frame, event, _: seen.add(frame.f_code) if event == "call" else None)
    try:
        for query in catalogue.QUERIES.values():
            query(spark, FOLDER)
    finally:
        sys.setprofile(None)
    missed = [(name, v) for name, v in FUNCTIONS.items() if name not in called and not set(v) <= PROGRAMS and getattr(resolve(name), "__code__", None) not in seen]
    assert not missed
