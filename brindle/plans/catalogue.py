"""One query per operation over whole driver tables, each with the DuckDB SQL of the same result.

``COVERS`` says which rows of the operator inventory a query exercises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, bits, decisions, numeric, text
from ..operators import iterative, relational, sampling, sets, stateful
from ..sources import greeters, table
from ..streaming import bill_stream, sale_stream, stock_stream, vote_states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, tuple[int, ...]] = {}


def _joined(array) -> F.Column:
    """An array as text, so that results compare as plain values."""
    return F.array_join(F.col(array).cast("array<string>") if isinstance(array, str) else array.cast("array<string>"), ",")


def query(covers: tuple[int, ...], sql: str | None = None):
    """Register a function under its name."""

    def add(f):
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- selection and search -----------------------------------------------------------------------------------


@query((1,), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25")
def keep(spark, d):
    return relational.keep(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), F.col("l_quantity") > 25)


@query((2,), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity > 25)")
def discard(spark, d):
    return relational.discard(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), F.col("l_quantity") > 25)


@query((1, 2), """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([l_orderkey, l_partkey, l_suppkey], lambda x: x % 2 = 0), ',') kept,
array_to_string(list_filter([l_orderkey, l_partkey, l_suppkey], lambda x: x % 2 <> 0), ',') dropped FROM lineitem""")
def keep_discard_arrays(spark, d):
    keys, even = F.array("l_orderkey", "l_partkey", "l_suppkey"), lambda x: x % 2 == 0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _joined(arrays.keep(keys, even)).alias("kept"), _joined(arrays.discard(keys, even)).alias("dropped"))


@query((3,), "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name = 'red widget' ORDER BY p_partkey LIMIT 1")
def find_first_by_title(spark, d):
    return relational.find_first(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), F.col("p_name") == "red widget", "p_partkey")


@query((4,), "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'widget')")
def find_contains(spark, d):
    return relational.find_containing(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "widget")


_STORE_SQL = "SELECT p_name title, p_brand author, CAST(p_retailprice AS DOUBLE) price, CAST(p_size AS BIGINT) in_stock, row_number() OVER (ORDER BY p_partkey) - 1 ins_seq FROM part"


def _parts_store(spark, d):
    """A new store with a book of each part, by number of the part."""
    book = relational.new_book(F.col("p_name"), F.col("p_brand"), F.col("p_retailprice"), F.col("p_size"))
    books = table(spark, d, "part").select(*[c.alias(n) for c, n in zip(book, ("title", "author", "price", "in_stock"))], "p_partkey")
    return relational.add_books(relational.new_book_store(spark), books, ["p_partkey"])


@query((5, 6, 7, 8, 154), f"SELECT *, in_stock > 0 has_stock FROM ({_STORE_SQL})")
def demo_store(spark, d):
    return _parts_store(spark, d).withColumn("has_stock", decisions.has_stock("in_stock"))


@query((5, 6, 7), f"""WITH s AS ({_STORE_SQL}) SELECT * FROM s UNION ALL
SELECT title, author, price, in_stock, (SELECT count(*) FROM s) + row_number() OVER (ORDER BY price DESC, ins_seq) - 1 FROM s WHERE in_stock > 45""")
def append_rows(spark, d):
    """The store with its large books once more, dearest first."""
    store = _parts_store(spark, d)
    more = store.where("in_stock > 45").withColumn("fall", -F.col("price"))
    return relational.add_books(store, more, ["fall", "ins_seq"])


_WORDS_SQL = """w AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '([\\s\\x{0085}\\p{Z}]|[^\\PP''])+', ' ', 'g'), ' ')) raw FROM documents),
n AS (SELECT regexp_replace(regexp_replace(raw, '[^\\p{L}\\p{Nd}'']', '', 'g'), '^''+|''+$', '', 'g') word FROM w)"""


@query((13, 14), f"WITH {_WORDS_SQL} SELECT word, count(*) n FROM n WHERE word <> '' GROUP BY word")
def word_count(spark, d):
    return relational.word_counts(table(spark, d, "documents"), "text")


@query((9, 10), f"""WITH {_WORDS_SQL}, u AS MATERIALIZED (SELECT DISTINCT word FROM n WHERE word <> ''),
k AS MATERIALIZED (SELECT word, array_to_string(list_sort(string_split(lower(word), '')), '') letters FROM u)
SELECT DISTINCT a.word, b.word other FROM k a JOIN k b ON a.letters = b.letters AND lower(a.word) <> lower(b.word)""")
def anagram_pairs(spark, d):
    return relational.anagram_pairs(relational.word_counts(table(spark, d, "documents"), "text"))


@query((9, 10), f"""WITH {_WORDS_SQL}, k AS (SELECT DISTINCT word, array_to_string(list_sort(string_split(lower(word), '')), '') letters FROM n WHERE word <> ''),
c AS (SELECT letters, count(*) members FROM k GROUP BY letters HAVING count(*) > 1)
SELECT word, letters, members, members * (members - 1) pairs FROM k JOIN c USING (letters)""")
def anagram_classes(spark, d):
    """Every word that has anagrams, with the size of its class and the pairs in it."""
    classes = relational.anagram_classes(relational.word_counts(table(spark, d, "documents"), "text"))
    return classes.select(F.explode("words").alias("word"), "letters", "members", "pairs")


@query((9, 10), """SELECT p_partkey, array_to_string(list_sort(string_split(p_name, '')), '') letters,
array_to_string(list_filter([reverse(p_name), upper(p_name), p_type], lambda c: lower(c) <> lower(p_name) AND array_to_string(list_sort(string_split(lower(c), '')), '') = array_to_string(list_sort(string_split(lower(p_name), '')), '')), ',') found FROM part""")
def anagram_candidates(spark, d):
    candidates = F.array(F.reverse("p_name"), F.upper("p_name"), "p_type")
    return table(spark, d, "part").select("p_partkey", text.sort_letters("p_name").alias("letters"), _joined(text.anagrams("p_name", candidates)).alias("found"))


# ---- aggregation ------------------------------------------------------------------------------------------------


@query((11,), "SELECT p_brand, CAST(coalesce(sum(CAST(p_retailprice AS DECIMAL(18,2)) * p_size), 0) AS DOUBLE) AS value FROM part GROUP BY p_brand")
def inventory_value(spark, d):
    return relational.inventory_value(table(spark, d, "part"), "p_retailprice", "p_size", ["p_brand"]).withColumn("value", F.col("value").cast("double"))


@query((12,), "SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) total FROM events GROUP BY user_id")
def total_by_key(spark, d):
    return relational.total_by(table(spark, d, "events"), "user_id", "value").withColumn("total", F.col("total").cast("double"))


@query((15,), """WITH s AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') t, text FROM documents)
SELECT doc_id, len(t) - len(replace(t, 'A', '')) a, len(t) - len(replace(t, 'C', '')) c, len(t) - len(replace(t, 'G', '')) g, len(t) - len(replace(t, 'T', '')) t, regexp_full_match(text, '[ACGT]*') valid FROM s""")
def char_histogram(spark, d):
    strand = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    counts = text.letter_histogram(strand)
    return table(spark, d, "documents").select("doc_id", *[counts[x].alias(x.lower()) for x in "ACGT"], text.letter_histogram("text").isNotNull().alias("valid"))


_BOARD_SQL = "[[(n_nationkey * 31 + f * 8 + r) % 3 = 0 for r in range(0, 8)] for f in range(0, 8)]"


@query((16, 17, 18, 19), f"""WITH b AS (SELECT n_nationkey, {_BOARD_SQL} q FROM nation)
SELECT n_nationkey, len(list_filter(q[3], lambda x: x)) file_c, 0::bigint file_z, len(list_filter(q, lambda f: f[5])) rank_5, 0::bigint rank_9,
list_sum([len(f) for f in q])::bigint squares, list_sum([len(list_filter(f, lambda x: x)) for f in q])::bigint occupied FROM b""")
def chess_counts(spark, d):
    squares = [F.array(*[(F.col("n_nationkey") * 31 + f * 8 + r) % 3 == 0 for r in range(8)]) for f in range(8)]
    board = F.map_from_arrays(F.array(*map(F.lit, "ABCDEFGH")), F.array(*squares))
    b = table(spark, d, "nation").select("n_nationkey", board.alias("b"))
    return b.select("n_nationkey", arrays.count_in_file("b", "C").alias("file_c"), arrays.count_in_file("b", "Z").alias("file_z"), arrays.count_in_rank("b", 5).alias("rank_5"), arrays.count_in_rank("b", 9).alias("rank_9"), arrays.count_squares("b").alias("squares"), arrays.count_occupied("b").alias("occupied"))


@query((20, 41, 42, 43), """WITH t AS (SELECT n_nationkey k, [CASE i % 4 WHEN 0 THEN 'Noodles' WHEN 1 THEN 'sauce' WHEN 2 THEN 'mozzarella' ELSE 'SAUCE' END for i in range(1, n_nationkey + 2)] l FROM nation)
SELECT k, len(list_filter(l, lambda x: lower(x) = 'noodles')) * 50 noodles, list_reduce(list_prepend(0.0::double, [0.2::double for x in l if lower(x) = 'sauce']), lambda a, x: a + x) sauce,
len(l) * 2 usual, len(l) * 3 slow, array_to_string(list_append(l[1:len(l) - 1], 'secret'), ',') mine, 1.5::double * (k / 2.0::double) small, 100.0::double * (k / 2.0::double) large FROM t""")
def recipes(spark, d):
    kind = lambda i: F.when(i % 4 == 0, "Noodles").when(i % 4 == 1, "sauce").when(i % 4 == 2, "mozzarella").otherwise("SAUCE")
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.transform(F.sequence(F.lit(1), F.col("n_nationkey") + 1), kind).alias("l"))
    q = arrays.layer_quantities("l")
    scaled = arrays.scale_recipe(F.array(F.lit(1.5), F.lit(100.0)), F.col("k"))
    secret = arrays.add_secret_ingredient(F.array(F.lit("plain"), F.lit("secret")), "l")
    return t.select("k", q["noodles"].alias("noodles"), q["sauce"].alias("sauce"), arrays.layers_time("l", 0).alias("usual"), arrays.layers_time("l", 3).alias("slow"), _joined(secret).alias("mine"), scaled[0].alias("small"), scaled[1].alias("large"))


@query((21, 22), """SELECT p_partkey, CAST(list_sum([CASE WHEN c IN ('D', 'G') THEN 2 WHEN c IN ('B', 'C', 'M', 'P') THEN 3 WHEN c IN ('F', 'H', 'V', 'W', 'Y') THEN 4
WHEN c = 'K' THEN 5 WHEN c IN ('J', 'X') THEN 8 WHEN c IN ('Q', 'Z') THEN 10 ELSE 1 END for c in string_split(upper(p_name), '')]) AS BIGINT) score FROM part""")
def letter_score(spark, d):
    return table(spark, d, "part").select("p_partkey", text.letter_score("p_name").alias("score"))


@query((23,), """SELECT o_orderkey, CAST(len(list_filter(list_zip(string_split(lpad(o_orderkey::varchar, 9, '0'), ''), string_split(lpad(o_custkey::varchar, 9, '0'), '')), lambda z: z[1] <> z[2])) AS BIGINT) distance,
-1::bigint unequal FROM orders""")
def hamming(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.hamming_distance(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("distance"), F.coalesce(text.hamming_distance("o_orderstatus", "o_orderpriority"), F.lit(-1).cast("long")).alias("unequal"))


# ---- windows by position -------------------------------------------------------------------------------------------


@query((24,), """SELECT user_id, rn // 7 + 1 AS week, CAST(sum(v) AS DOUBLE) total FROM (SELECT user_id, CAST(value AS DECIMAL(18,2)) v,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 rn FROM events) GROUP BY 1, 2 HAVING count(*) = 7""")
def count_tumbling_7(spark, d):
    return relational.tumbling_totals(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").withColumn("total", F.col("total").cast("double"))


@query((25,), """SELECT event_id, user_id, CAST(CAST(value AS DECIMAL(18,2)) + CASE WHEN (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM events""")
def fix_alternate(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    return relational.fix_alternate(rows, "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", F.col("value").cast("double").alias("value"))


@query((12, 24, 25), """WITH s AS (SELECT n_nationkey k, [(i * 7 + n_nationkey) % 5 for i in range(0, n_nationkey)] c FROM nation)
SELECT k, coalesce(list_sum(c), 0)::bigint total, CASE WHEN len(c) >= 14 THEN list_sum(c[8:14]) ELSE 0 END::bigint week_2, 0::bigint week_0,
array_to_string([(i * 7 + k) % 5 + CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END for i in range(0, k)], ',') fixed FROM s""")
def bird_weeks(spark, d):
    counts = F.when(F.col("n_nationkey") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_nationkey").cast("long") - 1, F.lit(0).cast("long"))), lambda i: (i * 7 + F.col("n_nationkey")) % 5)).otherwise(F.array().cast("array<bigint>"))
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), counts.alias("c"))
    return s.select("k", arrays.series_total("c").alias("total"), arrays.week_total("c", 2).alias("week_2"), arrays.week_total("c", 0).alias("week_0"), _joined(arrays.fix_alternate("c")).alias("fixed"))


@query((26,), """SELECT c_custkey, list_max([d[i]::int * d[i + 1]::int * d[i + 2]::int for i in range(1, len(d) - 1)])::bigint product FROM (SELECT c_custkey, string_split(lpad((c_custkey * 7919 + 123456789)::varchar, 12, '5'), '') d FROM customer)""")
def largest_series_product(spark, d):
    digits = F.lpad((F.col("c_custkey") * 7919 + 123456789).cast("string"), 12, "5")
    return table(spark, d, "customer").select("c_custkey", arrays.largest_product(digits, 3).cast("long").alias("product"))


# ---- arrays and maps ----------------------------------------------------------------------------------------------------


@query((27, 28, 29, 30, 31), """SELECT l_orderkey, l_linenumber, '2,6,9' favourites, CASE WHEN l_linenumber - 2 BETWEEN 0 AND 2 THEN [2, 6, 9][l_linenumber - 1] ELSE -1 END::bigint item,
CASE l_linenumber - 2 WHEN 0 THEN '99,6,9' WHEN 1 THEN '2,99,9' WHEN 2 THEN '2,6,99' ELSE '2,6,9,99' END changed,
l_linenumber || ',0,2,6,9' longer, CASE l_linenumber - 2 WHEN 0 THEN '6,9' WHEN 1 THEN '2,9' WHEN 2 THEN '2,6' ELSE '2,6,9' END shorter FROM lineitem""")
def card_ops(spark, d):
    cards, i = arrays.favourite_cards(), F.col("l_linenumber") - 2
    more = F.array(F.col("l_linenumber").cast("long"), F.lit(0).cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _joined(cards).alias("favourites"), arrays.get_item(cards, i).cast("long").alias("item"), _joined(arrays.set_item(cards, i, F.lit(99).cast("long"))).alias("changed"), _joined(arrays.prepend_items(cards, more)).alias("longer"), _joined(arrays.remove_item(cards, i)).alias("shorter"))


@query((32,), "SELECT lower(p_brand) letter, max(p_size) score FROM part GROUP BY 1")
def etl_invert(spark, d):
    scores = table(spark, d, "part").groupBy("p_size").agg(F.collect_set("p_brand").alias("brands"))
    return relational.invert_map(scores, "p_size", "brands")


_UNIT_SQL = "CASE l_linenumber WHEN 1 THEN 'quarter_of_a_dozen' WHEN 2 THEN 'half_of_a_dozen' WHEN 3 THEN 'dozen' WHEN 4 THEN 'small_gross' WHEN 5 THEN 'gross' WHEN 6 THEN 'great_gross' ELSE 'crate' END"
_UNIT_VALUES = "(VALUES ('quarter_of_a_dozen', 3), ('half_of_a_dozen', 6), ('dozen', 12), ('small_gross', 120), ('gross', 144), ('great_gross', 1728)) u(unit, quantity)"


def _unit_items(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), F.expr(_UNIT_SQL).alias("unit"))


@query((33, 35), f"SELECT item, CAST(sum(quantity) AS BIGINT) quantity FROM (SELECT l_partkey item, {_UNIT_SQL} unit FROM lineitem) JOIN {_UNIT_VALUES} USING (unit) GROUP BY item")
def unit_lookup(spark, d):
    return relational.bill_totals(_unit_items(spark, d))


@query((35,), f"SELECT l_orderkey, l_partkey item, {_UNIT_SQL} unit FROM lineitem WHERE {_UNIT_SQL} = 'crate'")
def unknown_units(spark, d):
    return relational.unknown_units(_unit_items(spark, d))


@query((34, 36, 37), f"""WITH RECURSIVE o AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) rn, CASE WHEN l_quantity > 20 THEN 'add' ELSE 'remove' END op, quantity
  FROM (SELECT *, {_UNIT_SQL} unit FROM lineitem) LEFT JOIN {_UNIT_VALUES} USING (unit)),
r(l_suppkey, rn, bill, accepted) AS (SELECT DISTINCT l_suppkey, 0::bigint, NULL::bigint, 0::bigint FROM o UNION ALL
  SELECT r.l_suppkey, o.rn, CASE WHEN o.quantity IS NULL THEN bill WHEN op = 'add' THEN coalesce(bill, 0) + o.quantity WHEN bill = o.quantity THEN NULL WHEN bill > o.quantity THEN bill - o.quantity ELSE bill END,
  accepted + CASE WHEN o.quantity IS NULL THEN 0 WHEN op = 'add' THEN 1 WHEN bill >= o.quantity THEN 1 ELSE 0 END FROM r JOIN o ON o.l_suppkey = r.l_suppkey AND o.rn = r.rn + 1)
SELECT l_suppkey, coalesce(arg_max(bill, rn) FILTER (bill IS NOT NULL AND rn = m), 0)::bigint quantity, max(accepted) accepted FROM (SELECT *, max(rn) OVER (PARTITION BY l_suppkey) m FROM r) GROUP BY l_suppkey""")
def bill_fold(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_quantity") > 20, "add").otherwise("remove").alias("op"), F.lit("peas").alias("item"), F.expr(_UNIT_SQL).alias("unit"))
    folded = stateful.bills(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return folded.select("l_suppkey", arrays.bill_quantity("bill", "peas")["quantity"].alias("quantity"), "accepted")


_ITEM_SQL = "CASE l_partkey % 3 WHEN 0 THEN 'peas' WHEN 1 THEN 'corn' ELSE 'rice' END"


@query((34, 36, 37), f"""WITH RECURSIVE o AS (SELECT l_suppkey, item, row_number() OVER (PARTITION BY l_suppkey, item ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) rn, CASE WHEN l_quantity > 20 THEN 'add' ELSE 'remove' END op, quantity
  FROM (SELECT *, {_UNIT_SQL} unit, {_ITEM_SQL} item FROM lineitem) LEFT JOIN {_UNIT_VALUES} USING (unit)),
r(l_suppkey, item, rn, bill) AS (SELECT DISTINCT l_suppkey, item, 0::bigint, NULL::bigint FROM o UNION ALL
  SELECT r.l_suppkey, r.item, o.rn, CASE WHEN o.quantity IS NULL THEN bill WHEN op = 'add' THEN coalesce(bill, 0) + o.quantity WHEN bill = o.quantity THEN NULL WHEN bill > o.quantity THEN bill - o.quantity ELSE bill END
  FROM r JOIN o ON o.l_suppkey = r.l_suppkey AND o.item = r.item AND o.rn = r.rn + 1)
SELECT l_suppkey, item, bill quantity FROM (SELECT *, max(rn) OVER (PARTITION BY l_suppkey, item) m FROM r) WHERE rn = m AND bill IS NOT NULL""")
def bill_items(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_quantity") > 20, "add").otherwise("remove").alias("op"), F.expr(_ITEM_SQL).alias("item"), F.expr(_UNIT_SQL).alias("unit"))
    return stateful.bill_lines(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]).where("quantity is not null").select("l_suppkey", "item", "quantity")


@query((34, 36, 37), ORACLE_SQL["bill_items"].replace("SELECT l_suppkey, item, bill quantity", "SELECT l_suppkey::varchar AS key, item, bill quantity"))
def bill_states(spark, d):
    """The same bills from keyed state, as a stream keeps it."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("at"), F.when(F.col("l_quantity") > 20, "add").otherwise("remove").alias("op"), F.expr(_ITEM_SQL).alias("item"), F.expr(_UNIT_SQL).alias("unit"))
    return bill_stream(rows, "l_suppkey", "at").where("item is not null").select("key", "item", "quantity")


_COLOURS_SQL = "['black', 'brown', 'red', 'orange', 'yellow', 'green', 'blue', 'violet', 'grey', 'white']"


@query((38, 39, 40), f"""WITH b AS (SELECT l_orderkey, l_linenumber, [CASE WHEN k < 10 THEN {_COLOURS_SQL}[k + 1] ELSE 'pink' END for k in [l_linenumber, l_orderkey % 11, 3]] c FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(list_position({_COLOURS_SQL}, c[2]) - 1, -1)::bigint code, (greatest(coalesce(list_position({_COLOURS_SQL}, c[1]) - 1, 0), 0) * 10 + greatest(coalesce(list_position({_COLOURS_SQL}, c[2]) - 1, 0), 0))::bigint AS value, 0::bigint one FROM b""")
def colour_bands(spark, d):
    name = lambda k: F.coalesce(F.get(arrays.colours(), k.cast("int")), F.lit("pink"))
    bands = F.array(name(F.col("l_linenumber")), name(F.col("l_orderkey") % 11), name(F.lit(3)))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bands.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", arrays.colour_code(F.col("c")[1]).alias("code"), arrays.colour_value("c").alias("value"), arrays.colour_value(F.slice("c", 1, 1)).alias("one"))


# ---- decisions -----------------------------------------------------------------------------------------------------------


@query((44, 45, 46, 47), """WITH t AS (SELECT DISTINCT l_orderkey % 2 = 0 k, l_partkey % 2 = 0 a, l_suppkey % 2 = 0 p, l_linenumber % 2 = 0 g FROM lineitem)
SELECT k, a, p, g, NOT k attack, k OR a OR p spy, NOT a AND p AS signal, (p AND NOT k AND NOT a) OR (g AND NOT a) AS free FROM t""")
def infiltration(spark, d):
    even = lambda c, n: (F.col(c) % 2 == 0).alias(n)
    t = table(spark, d, "lineitem").select(even("l_orderkey", "k"), even("l_partkey", "a"), even("l_suppkey", "p"), even("l_linenumber", "g")).distinct()
    return t.select("*", decisions.can_fast_attack("k").alias("attack"), decisions.can_spy("k", "a", "p").alias("spy"), decisions.can_signal_prisoner("a", "p").alias("signal"), decisions.can_free_prisoner("k", "a", "p", "g").alias("free"))


_CARDS = [*decisions.CARD_VALUES, "joker"]
_CARD_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in decisions.CARD_VALUES.items()) + " ELSE 0 END"


@query((48, 49), f"""WITH n AS (SELECT {_CARDS} n), t AS (SELECT DISTINCT n[l_orderkey % 14 + 1] c1, n[l_partkey % 14 + 1] c2, n[l_suppkey % 14 + 1] dealer FROM lineitem, n),
v AS (SELECT *, {_CARD_SQL.replace("CASE c ", "CASE c1 ")} + {_CARD_SQL.replace("CASE c ", "CASE c2 ")} h, {_CARD_SQL.replace("CASE c ", "CASE dealer ")} q FROM t)
SELECT c1, c2, dealer, h::bigint hand, CASE WHEN c1 = 'ace' AND c2 = 'ace' THEN 'P' WHEN h = 21 AND q < 10 THEN 'W' WHEN h BETWEEN 12 AND 16 AND q >= 7 OR h <= 11 THEN 'H' ELSE 'S' END turn FROM v""")
def blackjack(spark, d):
    name = lambda c, n: F.get(F.array(*map(F.lit, _CARDS)), (F.col(c) % 14).cast("int")).alias(n)
    t = table(spark, d, "lineitem").select(name("l_orderkey", "c1"), name("l_partkey", "c2"), name("l_suppkey", "dealer")).distinct()
    return t.select("*", (decisions.card_value("c1") + decisions.card_value("c2")).alias("hand"), decisions.first_turn("c1", "c2", "dealer").alias("turn"))


@query((50, 51, 52), """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'car' WHEN p_size % 3 = 1 THEN 'truck' ELSE 'bike' END IN ('car', 'truck') license, least(p_name, p_type) || ' is clearly the better choice.' choice,
p_retailprice * CASE WHEN p_size / 4.0::double >= 10 THEN 0.5::double WHEN p_size / 4.0::double < 3 THEN 0.8::double ELSE 0.7::double END resell FROM part""")
def vehicles(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "car").when(F.col("p_size") % 3 == 1, "truck").otherwise("bike")
    return table(spark, d, "part").select("p_partkey", decisions.needs_license(kind).alias("license"), decisions.choose_vehicle("p_name", "p_type").alias("choice"), decisions.resell_price("p_retailprice", F.col("p_size") / F.lit(4.0)).alias("resell"))


@query((53, 54, 55, 56), """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity a, (l_partkey % 50)::double b, (l_suppkey % 50)::double c FROM lineitem),
k AS (SELECT *, a > 0 AND b > 0 AND c > 0 AND a + b >= c AND a + c >= b AND b + c >= a ok FROM t)
SELECT l_orderkey, l_linenumber, ok valid, a = b AND b = c equal, a = b OR a = c OR b = c two, CASE WHEN NOT ok THEN 0 WHEN a = b AND b = c THEN 1 WHEN a = b OR a = c OR b = c THEN 2 ELSE 3 END kind FROM k""")
def triangles(spark, d):
    sides = ("l_quantity", (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 50).cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", decisions.is_triangle(*sides).alias("valid"), decisions.all_equal(*sides).alias("equal"), decisions.any_two_equal(*sides).alias("two"), decisions.triangle_kind(*sides).alias("kind"))


@query((57, 58), """SELECT l_orderkey, l_linenumber, sqrt(x * x + y * y) distance, CASE WHEN sqrt(x * x + y * y) <= 1 THEN 10 WHEN sqrt(x * x + y * y) <= 5 THEN 5 WHEN sqrt(x * x + y * y) <= 10 THEN 1 ELSE 0 END::bigint score
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 5.0::double x, l_discount * 40 y FROM lineitem)""")
def darts(spark, d):
    x, y = F.col("l_quantity") / F.lit(5.0), F.col("l_discount") * 40
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", decisions.distance_from_center(x, y).alias("distance"), decisions.ring_score(x, y).alias("score"))


_RATE_SQL = "CASE WHEN c_acctbal < 0 THEN 3.213::float WHEN c_acctbal < 1000 THEN 0.5::float WHEN c_acctbal < 5000 THEN 1.621::float ELSE 2.475::float END"


@query((59, 123, 124), f"SELECT c_custkey, ({_RATE_SQL})::double rate, c_acctbal * ({_RATE_SQL})::double * 0.01::double interest, c_acctbal + c_acctbal * ({_RATE_SQL})::double * 0.01::double balance FROM customer")
def annual_balance(spark, d):
    return table(spark, d, "customer").select("c_custkey", decisions.interest_rate("c_acctbal").cast("double").alias("rate"), numeric.interest("c_acctbal").alias("interest"), numeric.annual_balance("c_acctbal").alias("balance"))


@query((60,), "SELECT o_orderkey, year(o_orderdate) % 400 = 0 OR (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) leap, (1600 + o_orderkey % 900) % 400 = 0 OR ((1600 + o_orderkey % 900) % 4 = 0 AND (1600 + o_orderkey % 900) % 100 <> 0) other FROM orders")
def leap_year(spark, d):
    return table(spark, d, "orders").select("o_orderkey", decisions.is_leap_year(F.year("o_orderdate")).alias("leap"), decisions.is_leap_year(1600 + F.col("o_orderkey") % 900).alias("other"))


_LOG_SQL = "CASE WHEN event_id % 5 = 0 THEN '❗' WHEN event_id % 5 = 1 THEN '🔍 then ☀' WHEN event_id % 5 = 2 THEN '☀' ELSE '' END || ' ' || event_type || ' é'"


@query((61, 62, 63), f"""SELECT event_id, CASE regexp_extract({_LOG_SQL}, '[❗🔍☀]') WHEN '❗' THEN 'recommendation' WHEN '🔍' THEN 'search' WHEN '☀' THEN 'weather' ELSE 'default' END app,
replace({_LOG_SQL}, 'é', '☀') replaced, length({_LOG_SQL}) <= 10 short FROM events""")
def log_lines(spark, d):
    log = F.concat(F.when(F.col("event_id") % 5 == 0, "❗").when(F.col("event_id") % 5 == 1, "🔍 then ☀").when(F.col("event_id") % 5 == 2, "☀").otherwise(""), F.lit(" "), "event_type", F.lit(" é"))
    return table(spark, d, "events").select("event_id", decisions.log_application(log).alias("app"), text.replace_character(log, "é", "☀").alias("replaced"), decisions.within_limit(log, 10).alias("short"))


# ---- text -----------------------------------------------------------------------------------------------------------------


@query((64,), "SELECT doc_id, reverse(text) reversed FROM documents")
def reverse(spark, d):
    return table(spark, d, "documents").select("doc_id", text.reverse_text("text").alias("reversed"))


@query((65, 66), """SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]'))) = 26 pangram,
len(list_distinct(regexp_extract_all(lower(text), '\\p{L}'))) = len(regexp_extract_all(lower(text), '\\p{L}')) isogram FROM documents""")
def letters_once(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_pangram("text").alias("pangram"), text.is_isogram("text").alias("isogram"))


@query((66,), """SELECT p_partkey, len(list_distinct(regexp_extract_all(lower(p_name), '\\p{L}'))) = len(regexp_extract_all(lower(p_name), '\\p{L}')) isogram,
len(list_distinct(regexp_extract_all(lower(p_brand), '\\p{L}'))) = len(regexp_extract_all(lower(p_brand), '\\p{L}')) brand_isogram FROM part""")
def isograms(spark, d):
    return table(spark, d, "part").select("p_partkey", text.is_isogram("p_name").alias("isogram"), text.is_isogram("p_brand").alias("brand_isogram"))


@query((67, 68, 69), """WITH t AS (SELECT p_partkey, lpad((p_partkey * 7919 % 1000000000)::varchar, 9, '0') || CASE WHEN p_size % 11 = 10 THEN 'X' ELSE (p_size % 11)::varchar END s FROM part)
SELECT p_partkey, s[1:1] || '-' || s[2:] isbn, list_sum([(CASE WHEN s[i] = 'X' THEN 10 ELSE s[i]::int END) * (11 - i) for i in range(1, 11)]) % 11 = 0 valid FROM t""")
def isbn(spark, d):
    last = F.when(F.col("p_size") % 11 == 10, "X").otherwise((F.col("p_size") % 11).cast("string"))
    plain = F.concat(F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0"), last)
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.substring(plain, 1, 1), F.lit("-"), F.substr(plain, F.lit(2))).alias("isbn"))
    return rows.select("p_partkey", "isbn", text.is_isbn("isbn").alias("valid"))


@query((70, 71), """WITH t AS (SELECT o_orderkey, lpad((o_orderkey * 7919 + o_custkey)::varchar, 8, '0') s FROM orders)
SELECT o_orderkey, list_sum([CASE WHEN i % 2 = 0 THEN s[8 - i]::int WHEN s[8 - i]::int > 4 THEN s[8 - i]::int * 2 - 9 ELSE s[8 - i]::int * 2 END for i in range(0, 8)]) % 10 = 0 valid FROM t""")
def luhn(spark, d):
    number = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 8, "0")
    return table(spark, d, "orders").select("o_orderkey", text.is_luhn(F.concat(F.substring(number, 1, 4), F.lit(" "), F.substr(number, F.lit(5)))).alias("valid"))


@query((72, 156), "SELECT doc_id, translate(regexp_replace(upper(text), '[^GCTA]', '', 'g'), 'GCTA', 'CGAU') rna FROM documents")
def rna(spark, d):
    return table(spark, d, "documents").select("doc_id", text.to_rna(F.upper("text")).alias("rna"))


_ABC, _ABC_UP = text.LOWER, text.UPPER


@query((73, 74, 75, 77, 78, 79), f"""SELECT p_partkey, translate(p_name, '{_ABC}{_ABC_UP}', '{_ABC[13:]}{_ABC[:13]}{_ABC_UP[13:]}{_ABC_UP[:13]}') rot13,
translate(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), '{_ABC}', '{_ABC[3:]}{_ABC[:3]}') caesar, regexp_replace(lower(p_name), '[^a-z]', '', 'g') back FROM part""")
def caesar(spark, d):
    cipher = text.Shift.caesar()
    return table(spark, d, "part").select("p_partkey", text.rotate("p_name", 13).alias("rot13"), cipher.encode("p_name").alias("caesar"), cipher.decode(cipher.encode("p_name")).alias("back"))


@query((75, 77, 78, 79), f"""SELECT s_suppkey, translate(regexp_replace(lower(s_name), '[^a-z]', '', 'g'), '{_ABC}', '{_ABC[7:]}{_ABC[:7]}') encoded, regexp_replace(lower(s_name), '[^a-z]', '', 'g') decoded FROM supplier""")
def shift_cipher(spark, d):
    cipher = text.Shift.new(7)
    return table(spark, d, "supplier").select("s_suppkey", cipher.encode("s_name").alias("encoded"), cipher.decode(cipher.encode("s_name")).alias("decoded"))


@query((76, 80, 81), """WITH t AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') s FROM part)
SELECT p_partkey, coalesce(array_to_string([chr(((ascii(s[i]) - 97 + ascii(('lemon')[(i - 1) % 5 + 1]) - 97) % 26 + 97)::int) for i in range(1, len(s) + 1)], ''), '') encoded, s decoded FROM t""")
def vigenere(spark, d):
    cipher = text.Vigenere.new("lemon")
    return table(spark, d, "part").select("p_partkey", cipher.encode("p_name").alias("encoded")).select("p_partkey", "encoded", cipher.decode("encoded").alias("decoded"))


@query((82,), f"""WITH t AS (SELECT o_orderkey, o_orderkey % 4100 n FROM orders)
SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 3999 THEN {" || ".join(f"{list(x)}[n // {10 ** (3 - k)} % 10 + 1]" for k, x in enumerate(text.NUMERALS))} END roman FROM t""")
def roman(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.to_roman(F.col("o_orderkey") % 4100).alias("roman"))


@query((83,), """SELECT o_orderkey, CASE WHEN s = '' THEN o_orderkey::varchar ELSE s END sound FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Pling' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'Plang' ELSE '' END
|| CASE WHEN o_orderkey % 7 = 0 THEN 'Plong' ELSE '' END s FROM orders)""")
def raindrops(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.raindrops("o_orderkey").alias("sound"))


@query((84, 85, 86, 87, 88, 94), """SELECT c_custkey, 'Welcome to the Tech Palace, ' || upper(c_mktsegment) welcome, repeat('*', c_nationkey) || chr(10) || c_name || chr(10) || repeat('*', c_nationkey) border,
c_name cleaned, 'One for ' || CASE WHEN c_nationkey % 2 = 0 THEN 'you' ELSE c_name END || ', one for me.' two_for, 'Hello, World!' hello FROM customer""")
def messages(spark, d):
    dirty = F.concat(F.lit("**\t\n "), "c_name", F.lit(" * *"))
    name = F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.welcome_customer("c_mktsegment").alias("welcome"), text.add_border("c_name", "c_nationkey").alias("border"), text.clean_message(dirty).alias("cleaned"), text.two_for(name).alias("two_for"), text.hello_world().alias("hello"))


@query((89, 90, 91, 92, 93), """SELECT c_custkey, language, 'I can speak ' || language || ': ' || greeting || ' ' || c_name || '!' hello FROM customer, (VALUES ('Italian', 'Ciao'), ('Portuguese', 'Olá')) g(language, greeting)""")
def greetings(spark, d):
    spoken = F.explode(F.array(*[F.struct(F.lit(x).alias("language"), text.say_hello("c_name", x).alias("hello")) for x in text.GREETINGS]))
    return table(spark, d, "customer").select("c_custkey", spoken.alias("g")).select("c_custkey", "g.*")


@query((89,), """SELECT c_custkey, language, replace(template, '%s', c_name) greeting FROM customer JOIN (VALUES (0, 'Italian', 'Ciao %s!'), (1, 'Portuguese', 'Olá %s!')) t(k, language, template) ON c_nationkey % 3 = k""")
def greeter_table(spark, d):
    """Customers greeted by the table of templates, as far as their language is in it."""
    language = F.when(F.col("c_nationkey") % 3 == 0, "Italian").when(F.col("c_nationkey") % 3 == 1, "Portuguese").otherwise("German")
    known = F.broadcast(greeters(spark))  # two rows
    return table(spark, d, "customer").select("c_custkey", "c_name", language.alias("language")).join(known, "language").select("c_custkey", "language", F.replace("template", F.lit("%s"), "c_name").alias("greeting"))


@query((95, 96, 97), """SELECT c_custkey, printf('Happy birthday %s! You are now %d years old!', c_name, c_nationkey) birthday, printf('Welcome to my party, %s!', c_name) || chr(10) ||
printf('You have been assigned to table %03d. Your table is %s, exactly %.1f meters from here.', c_nationkey, 'on the left', c_acctbal / 64) || chr(10) || printf('You will be sitting next to %s.', c_mktsegment) seat FROM customer""")
def party(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.happy_birthday("c_name", "c_nationkey").alias("birthday"), text.assign_table("c_name", "c_nationkey", "c_mktsegment", F.lit("on the left"), F.col("c_acctbal") / 64).alias("seat"))


@query((98, 99, 100, 101, 102), """SELECT c_custkey, c_mktsegment || ': ' || (c_nationkey - 5) || ' ' || ['°C', '°F'][c_custkey % 2 + 1] || ', Wind N at ' || (c_nationkey * 2) || ' ' || ['km/h', 'mph'][c_custkey % 3 + 1] || ', ' || (c_custkey % 100) || '% Humidity' weather FROM customer""")
def weather(spark, d):
    report = F.struct(
        F.col("c_mktsegment").alias("location"), F.struct((F.col("c_nationkey") - 5).alias("degree"), (F.col("c_custkey") % 2).alias("unit")).alias("temperature"), F.lit("N").alias("wind_direction"),
        F.struct((F.col("c_nationkey") * 2).alias("magnitude"), (F.col("c_custkey") % 3).alias("unit")).alias("wind_speed"), (F.col("c_custkey") % 100).alias("humidity"),
    )
    return table(spark, d, "customer").select("c_custkey", text.show_weather(report).alias("weather"))


@query((106, 107, 108, 109, 110, 111), """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN printf('This is the number %.1f', s_acctbal / 3) WHEN 1 THEN printf('This is the number %.1f', s_nationkey::double) WHEN 2 THEN printf('This is a box containing the number %.1f', s_nationkey::double)
WHEN 3 THEN printf('This is a fancy box containing the number %.1f', s_nationkey::double) WHEN 4 THEN 'This is a fancy box containing the number 0.0' ELSE 'Return to sender' END said, CASE WHEN s_suppkey % 6 = 3 THEN s_nationkey ELSE 0 END::bigint extracted FROM supplier""")
def sorting_room(spark, d):
    n = F.col("s_suppkey") % 6
    kind = F.when(n == 0, "float").when(n == 1, "int").when(n == 2, "box").when(n == 3, "fancy").when(n == 4, "other_fancy").otherwise("letter")
    thing = F.struct(kind.alias("kind"), F.when(n == 0, F.col("s_acctbal") / 3).otherwise(F.col("s_nationkey").cast("double")).alias("d"), F.col("s_nationkey").cast("string").alias("s"))
    return table(spark, d, "supplier").select("s_suppkey", thing.alias("t")).select("s_suppkey", text.describe_anything("t").alias("said"), text.extract_fancy("t.kind", text.fancy_value("t")).alias("extracted"))


@query((106, 107, 110), """SELECT s_suppkey, printf('This is the number %.1f', s_acctbal / 3) number, printf('This is a box containing the number %.1f', s_acctbal / 7) box,
CASE WHEN s_suppkey % 2 = 0 THEN printf('This is a fancy box containing the number %.1f', s_nationkey::double) ELSE 'This is a fancy box containing the number 0.0' END fancy FROM supplier""")
def number_boxes(spark, d):
    kind = F.when(F.col("s_suppkey") % 2 == 0, "fancy").otherwise("other_fancy")
    return table(spark, d, "supplier").select("s_suppkey", text.describe_number(F.col("s_acctbal") / 3).alias("number"), text.describe_box(F.col("s_acctbal") / 7).alias("box"), text.describe_fancy(kind, F.col("s_nationkey").cast("string")).alias("fancy"))


# ---- numbers and time ---------------------------------------------------------------------------------------------------------


@query((112, 113, 114), """SELECT p_partkey, p_partkey::double * p_size / 100.0::double per_hour, trunc(p_partkey::double * p_size / 100.0::double / 60.0::double)::bigint per_minute, p_partkey // 10 * 95000 + p_partkey % 10 * 10000 AS cost FROM part""")
def car_factory(spark, d):
    success = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", numeric.cars_per_hour("p_partkey", success).alias("per_hour"), numeric.cars_per_minute("p_partkey", success).alias("per_minute"), numeric.cars_cost("p_partkey").alias("cost"))


@query((115, 116, 117), """SELECT o_orderkey, (n * (n + 1) // 2) * (n * (n + 1) // 2) square_of_sum, n * (n + 1) * (2 * n + 1) // 6 sum_of_squares, (n * (n + 1) // 2) * (n * (n + 1) // 2) - n * (n + 1) * (2 * n + 1) // 6 difference FROM (SELECT o_orderkey, o_orderkey % 10000 n FROM orders)""")
def squares(spark, d):
    n = F.col("o_orderkey") % 10000
    return table(spark, d, "orders").select("o_orderkey", numeric.square_of_sum(n).alias("square_of_sum"), numeric.sum_of_squares(n).alias("sum_of_squares"), numeric.squares_difference(n).alias("difference"))


@query((118, 119), """WITH RECURSIVE t(id, n, k) AS (SELECT p_partkey, p_partkey, 0::bigint FROM part WHERE p_partkey >= 1 UNION ALL SELECT id, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, k + 1 FROM t WHERE n > 1)
SELECT p_partkey, coalesce(k, -1) steps, CASE WHEN p_partkey < 1 THEN printf('Error with value %d: Input must be greater than zero', p_partkey) END error FROM part LEFT JOIN (SELECT id, max(k) k FROM t GROUP BY id) ON id = p_partkey""")
def collatz(spark, d):
    return table(spark, d, "part").select("p_partkey", F.coalesce(numeric.collatz_steps("p_partkey"), F.lit(-1).cast("long")).alias("steps"), numeric.collatz_error("p_partkey").alias("error"))


@query((120,), """WITH RECURSIVE t(id, n, d, f) AS (SELECT p_partkey, p_partkey, 2::bigint, NULL::bigint FROM part WHERE p_partkey >= 1 UNION ALL SELECT id, CASE WHEN n % d = 0 THEN n // d WHEN d * d > n THEN 1 ELSE n END,
CASE WHEN n % d = 0 OR d * d > n THEN d WHEN d = 2 THEN 3 ELSE d + 2 END, CASE WHEN n % d = 0 THEN d WHEN d * d > n THEN n END FROM t WHERE n > 1)
SELECT id p_partkey, f factor, count(*) times FROM t WHERE f IS NOT NULL GROUP BY id, f""")
def prime_factors(spark, d):
    factors = table(spark, d, "part").select("p_partkey", F.explode(numeric.prime_factors("p_partkey")).alias("factor"))
    return factors.groupBy("p_partkey", "factor").agg(F.count("*").alias("times"))


@query((121,), """WITH n AS (SELECT range v FROM range(2, (SELECT max(p_partkey) + 1 FROM part))), c AS (SELECT DISTINCT a.v * b.v x FROM n a JOIN n b ON b.v >= a.v AND a.v * b.v <= (SELECT max(p_partkey) FROM part))
SELECT p_partkey prime, p_name FROM part JOIN (SELECT v FROM n ANTI JOIN c ON v = x) ON v = p_partkey""")
def sieve(spark, d):
    """Parts whose number is a prime."""
    return iterative.primes_among(table(spark, d, "part").select(F.col("p_partkey").alias("prime"), "p_name"), "prime")


@query((122,), """SELECT o_orderkey n, CASE WHEN o_orderkey % 15 = 0 THEN 'FizzBuzz' WHEN o_orderkey % 3 = 0 THEN 'Fizz' WHEN o_orderkey % 5 = 0 THEN 'Buzz' ELSE o_orderkey::varchar END line FROM orders WHERE o_orderkey > 0""")
def fizzbuzz(spark, d):
    return iterative.fizz_buzz_lines(table(spark, d, "orders").select(F.col("o_orderkey").alias("n")).where("n > 0"), "n")


@query((122,), """SELECT n_nationkey, coalesce(array_to_string([CASE WHEN i % 15 = 0 THEN 'FizzBuzz' WHEN i % 3 = 0 THEN 'Fizz' WHEN i % 5 = 0 THEN 'Buzz' ELSE i::varchar END || chr(10) for i in range(1, n_nationkey + 1)], ''), '') lines FROM nation""")
def fizzbuzz_text(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.fizz_buzz("n_nationkey").alias("lines"))


@query((125,), """WITH RECURSIVE t(c_custkey, c_acctbal, goal, k) AS (SELECT c_custkey, c_acctbal, c_acctbal * 1.5::double, 0::bigint FROM customer WHERE c_acctbal > 0 UNION ALL
SELECT c_custkey, c_acctbal + c_acctbal * (CASE WHEN c_acctbal < 0 THEN 3.213::float WHEN c_acctbal < 1000 THEN 0.5::float WHEN c_acctbal < 5000 THEN 1.621::float ELSE 2.475::float END)::double * 0.01::double, goal, k + 1 FROM t WHERE c_acctbal < goal)
SELECT c.c_custkey, CASE WHEN c.c_acctbal = 0 THEN 0 WHEN c.c_acctbal < 0 AND c.c_acctbal * 1.5 <= c.c_acctbal THEN 0 ELSE coalesce(k, -1) END AS years FROM customer c LEFT JOIN (SELECT c_custkey, max(k) k FROM t GROUP BY 1) x USING (c_custkey)""")
def years_to_target(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.coalesce(numeric.years_to_target("c_acctbal", F.col("c_acctbal") * 1.5), F.lit(-1).cast("long")).alias("years"))


@query((126, 127, 128), "SELECT l_orderkey, l_linenumber, 40 - l_partkey left_over, 2 * l_linenumber preparing, 2 * l_linenumber + l_partkey elapsed FROM lineitem")
def oven_times(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.oven_time_left("l_partkey").alias("left_over"), numeric.layering_time("l_linenumber").alias("preparing"), numeric.elapsed_time("l_linenumber", "l_partkey").alias("elapsed"))


@query((129,), "SELECT event_id, ts + INTERVAL 1000000000 SECONDS later FROM events")
def gigasecond(spark, d):
    return table(spark, d, "events").select("event_id", numeric.add_gigasecond("ts").alias("later"))


# ---- sets ------------------------------------------------------------------------------------------------------------------------


@query((130, 131, 134), "SELECT count(DISTINCT user_id) n FROM events")
def bitset_count(spark, d):
    return sets.BitSet.of(table(spark, d, "events"), "user_id").count()


@query((131, 132, 133), """WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 60))
SELECT event_id, user_id, user_id IN (SELECT user_id FROM s) there FROM events""")
def bitset_test(spark, d):
    events = table(spark, d, "events")
    chosen = sets.BitSet.of(events.where("event_type = 'error'"), "user_id").cleared(events.where("event_type = 'signup' and value > 60"), "user_id")
    return chosen.test(events.select("event_id", "user_id"), "user_id")


@query((131, 132, 133), """SELECT event_id, xor(-1::bigint, CASE WHEN user_id % 64 = 63 THEN (-9223372036854775808)::bigint ELSE 1::bigint << (user_id % 64)::int END) cleared, false there, user_id // 64 word FROM events WHERE user_id >= 0""")
def bit_words(spark, d):
    """Every position of a full word, cleared and tested."""
    full = table(spark, d, "events").where("user_id >= 0").select("event_id", "user_id", bits.clear_bit(F.lit(-1).cast("long"), "user_id").alias("cleared"))
    return full.select("event_id", "cleared", bits.test_bit("cleared", "user_id").alias("there"), bits.word_index("user_id").alias("word"))


@query((130, 131, 132, 134), """WITH s AS (SELECT DISTINCT l_orderkey k FROM lineitem WHERE l_quantity > 20 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4)
SELECT k // 32768 bucket, count(*)::int n FROM s GROUP BY 1""")
def bitset_buckets(spark, d):
    """Positions by container, after some are cleared."""
    lines = table(spark, d, "lineitem")
    held = sets.BitSet.of(lines.where("l_quantity > 20"), "l_orderkey").cleared(lines.where("l_linenumber > 4"), "l_orderkey")
    return held.rows.select("bucket", "n")


_FNV = "list_reduce(list_prepend(2166136261::bigint, [ascii(c)::bigint for c in string_split(p_brand, '')]), {})"
_FNV1 = _FNV.format("lambda h, b: xor((h * 16777619) & 4294967295, b)")
_FNV1A = _FNV.format("lambda h, b: (xor(h, b) * 16777619) & 4294967295")


@query((135, 136, 137), f"""WITH h AS (SELECT DISTINCT p_brand, {_FNV1} a, {_FNV1A} b FROM part), i AS (SELECT a % 64 x FROM h WHERE p_brand < 'Brand#2' UNION SELECT b % 64 FROM h WHERE p_brand < 'Brand#2')
SELECT p_brand, a fnv1, b fnv1a, a % 64 IN (SELECT x FROM i) AND b % 64 IN (SELECT x FROM i) maybe FROM h""")
def bloom_membership(spark, d):
    brands = table(spark, d, "part").select("p_brand").distinct()
    bloom = sets.BloomFilter(64, [bits.fnv1, bits.fnv1a])
    found = bloom.contains(brands, "p_brand", bloom.of(brands.where("p_brand < 'Brand#2'"), "p_brand"))
    return found.select("p_brand", bits.fnv1("p_brand").alias("fnv1"), bits.fnv1a("p_brand").alias("fnv1a"), "maybe")


@query((135, 136, 137), f"""WITH h AS (SELECT DISTINCT c_name, {_FNV1.replace("p_brand", "c_name")} a, {_FNV1A.replace("p_brand", "c_name")} b FROM customer),
i AS (SELECT a % 1048576 x FROM h SEMI JOIN (SELECT c_name FROM customer WHERE c_acctbal > 5000) USING (c_name) UNION SELECT b % 1048576 FROM h SEMI JOIN (SELECT c_name FROM customer WHERE c_acctbal > 5000) USING (c_name))
SELECT c_custkey, a % 1048576 IN (SELECT x FROM i) AND b % 1048576 IN (SELECT x FROM i) maybe FROM customer JOIN h USING (c_name)""")
def bloom_customers(spark, d):
    """A filter of a million bits, packed."""
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    bloom = sets.BloomFilter(1 << 20, [bits.fnv1, bits.fnv1a])
    return bloom.contains(customers, "c_name", bloom.of(customers.where("c_acctbal > 5000"), "c_name")).select("c_custkey", "maybe")


@query((135, 136, 137), """SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)""")
def filtered_join(spark, d):
    """Lines of the most urgent orders; other lines are dropped by a filter before the join."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    first = orders.agg(F.min("o_orderpriority").alias("p")).scalar()
    return sets.filtered_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders.where(F.col("o_orderpriority") == first), "l_orderkey")


# ---- random values ---------------------------------------------------------------------------------------------------------------------


@query((138, 139, 140))
def dice(spark, d):
    """A roll, a wand and a row of animals for each order."""
    return table(spark, d, "orders").select("o_orderkey", sampling.roll_die(1).alias("die"), sampling.wand_energy(2).alias("energy"), sampling.shuffled_animals(3).alias("animals"))


@query((138, 139, 140), "SELECT count(*) n, true dies, true all_sides, true energies, true animals, true differ FROM orders")
def dice_ranges(spark, d):
    """What holds for any seed: the ranges, all sides seen, and the animals in some order."""
    rolled, animals = dice(spark, d), F.array(*map(F.lit, sorted(sampling.ANIMALS)))
    inside = lambda c, low, high: F.bool_and((F.col(c) >= low) & (F.col(c) < high))
    return rolled.agg(F.count("*").alias("n"), inside("die", 1, 21).alias("dies"), (F.count_distinct("die") == 20).alias("all_sides"), inside("energy", 0, 12).alias("energies"), F.bool_and(F.array_sort("animals") == animals).alias("animals"), (F.count_distinct("animals") > 1).alias("differ"))


@query((155,))
def guess_game(spark, d):
    """The guesses of a game for each customer, whose number gives the target."""
    rows = table(spark, d, "customer").select("c_custkey", F.posexplode(iterative.guesses(F.col("c_custkey") % 100 + 1, "c_custkey")).alias("trial", "guess"))
    return rows.withColumn("trial", F.col("trial") + 1)


@query((155,), "SELECT c_custkey, c_custkey % 100 + 1 target, c_custkey % 100 + 1 AS last, true inside, true once, true narrowing FROM customer")
def guess_games(spark, d):
    """The last guess is the target, all are from 1 to 100, none comes twice, and each lies on the target's side of those before."""
    game = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100 + 1).alias("target"), iterative.guesses(F.col("c_custkey") % 100 + 1, "c_custkey").alias("g"))
    inside = F.forall("g", lambda x: x.between(1, 100))
    narrowing = F.forall(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.forall(F.slice("g", 1, s["i"]), lambda y: F.when(y < F.col("target"), s["x"] > y).otherwise(s["x"] < y)))
    return game.select("c_custkey", "target", F.element_at("g", -1).alias("last"), inside.alias("inside"), (F.size(F.array_distinct("g")) == F.size("g")).alias("once"), narrowing.alias("narrowing"))


# ---- state ---------------------------------------------------------------------------------------------------------------------------------


@query((8, 141), """SELECT p_partkey, p_size - least(p_size, coalesce(n, 0)) p_size, least(p_size, coalesce(n, 0)) sold, coalesce(n, 0) - least(p_size, coalesce(n, 0)) rejected, p_size > 0 stocked, CASE WHEN p_size < 1 THEN 'out_of_stock' END error
FROM (SELECT p_partkey, greatest(p_size - 10, 0)::bigint p_size FROM part) LEFT JOIN (SELECT l_partkey p_partkey, count(*) n FROM lineitem GROUP BY 1) USING (p_partkey)""")
def sell_books(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.greatest(F.col("p_size").cast("long") - 10, F.lit(0).cast("long")).alias("p_size"))
    parts = parts.withColumn("stocked", decisions.has_stock("p_size")).withColumn("error", stateful.sell_one("p_size")["error"])
    return relational.sell(parts, table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "p_size")


@query((8, 141), """WITH RECURSIVE e AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END change, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) rn FROM lineitem),
r(l_partkey, rn, stock, error) AS (SELECT p_partkey, 0::bigint, (p_size % 7)::bigint, NULL::varchar FROM part UNION ALL
  SELECT r.l_partkey, e.rn, CASE WHEN change < 0 AND stock < 1 THEN stock ELSE stock + change END, CASE WHEN change < 0 AND stock < 1 THEN 'out_of_stock' END FROM r JOIN e ON e.l_partkey = r.l_partkey AND e.rn = r.rn + 1)
SELECT l_orderkey, l_linenumber, l_quantity, e.l_partkey, change::bigint change, stock in_stock, error FROM e JOIN r ON e.l_partkey = r.l_partkey AND e.rn = r.rn""")
def sale_events(spark, d):
    """A row per line of an order: a sale of one, or one that comes back, with the stock after it and the error."""
    stock = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 7).cast("long").alias("stock"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).cast("long").alias("change"))
    sold = stateful.sale_events(lines.join(stock, "l_partkey"), "l_partkey", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], "stock", "change")
    return sold.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "change", "in_stock", "error")


@query((8, 141), """SELECT title, stock - least(stock, n) in_stock, least(stock, n) sold, n - least(stock, n) rejected FROM (SELECT p_partkey::varchar title, (p_size % 7)::bigint stock, n FROM part JOIN (SELECT l_partkey p_partkey, count(*) n FROM lineitem GROUP BY 1) USING (p_partkey))""")
def stock_states(spark, d):
    """Stock of each part after sales of one, from keyed state that begins with the table of parts."""
    stock = table(spark, d, "part").select(F.col("p_partkey").alias("title"), (F.col("p_size") % 7).alias("in_stock"))
    return stock_stream(table(spark, d, "lineitem"), "l_partkey", stock)


@query((8, 141), """WITH s AS (SELECT l_partkey, l_orderkey * 8 + l_linenumber place, (p_size % 7)::bigint stock FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT l_partkey, place, stock, row_number() OVER (PARTITION BY l_partkey ORDER BY place) rn FROM s)
SELECT l_partkey::varchar title, place "at", greatest(stock - rn, 0) in_stock, CASE WHEN rn > stock THEN 'out_of_stock' END error FROM n""")
def sale_states(spark, d):
    """A row for each sale, from the same state."""
    stock = table(spark, d, "part").select(F.col("p_partkey").alias("title"), (F.col("p_size") % 7).alias("in_stock"))
    return sale_stream(table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "l_partkey", "at", stock)


@query((142, 143, 144), """SELECT user_id::varchar candidate, (user_id % 10 + sum(event_id % 3))::bigint votes FROM events GROUP BY user_id""")
def vote_totals(spark, d):
    """Counters that begin with a table, from keyed state."""
    events = table(spark, d, "events")
    begun = events.select(F.col("user_id").alias("candidate"), (F.col("user_id") % 10).alias("votes")).distinct()
    return vote_states(events.withColumn("n", F.col("event_id") % 3), "user_id", "n", begun)


@query((142, 143, 144), "SELECT event_id, user_id, 5 + sum(event_id % 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint votes FROM events")
def running_votes(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 3).alias("add"))
    counted = stateful.running_votes(events, "user_id", ["ts", "event_id"], "add")
    return counted.select("event_id", "user_id", stateful.increment_votes(stateful.vote_count(stateful.vote_counter(5)), F.col("votes")).alias("votes"))


@query((103, 145, 146), """SELECT n_nationkey, n_name || ' (' || n_nationkey || ')' shown, n_nationkey - 1 fewer, -1::bigint absent FROM nation""")
def election(spark, d):
    result = stateful.election_result("n_name", "n_nationkey")
    votes = F.create_map("n_name", F.col("n_nationkey").cast("long"))
    less, other = stateful.decrement_votes(votes, F.col("n_name")), stateful.decrement_votes(votes, "nobody")
    return table(spark, d, "nation").select("n_nationkey", text.show_result(result["name"], result["votes"]).alias("shown"), F.element_at(less, F.col("n_name")).alias("fewer"), F.element_at(other, F.lit("nobody")).alias("absent"))


@query((104, 105, 147, 148, 149, 150, 151, 152, 153), """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity::bigint speed, l_linenumber * 7 drain, l_partkey track FROM lineitem),
k AS (SELECT *, least(l_linenumber, 99 // drain) a, least(l_linenumber, 100 // drain) b FROM c)
SELECT l_orderkey, l_linenumber, printf('Driven %d meters', a * speed) driven, printf('Battery at %d%%', 100 - a * drain) battery, a * speed distance, b * speed eager_distance, 100 - b * drain eager_battery, (100 // drain) * speed >= track strict, 100 >= (track // speed) * drain floored FROM k""")
def car_race(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stateful.new_car(F.col("l_quantity").cast("long"), F.col("l_linenumber") * 7).alias("car"), stateful.new_track("l_partkey").alias("track"))
    driven = rows.withColumn("x", stateful.drive("car", F.col("l_linenumber"))).withColumn("y", stateful.drive("car", F.col("l_linenumber"), spare=False))
    car = ("car.speed", "car.drain", "car.battery", "track.distance")
    return driven.select("l_orderkey", "l_linenumber", text.show_distance("x.distance").alias("driven"), text.show_battery("x.battery").alias("battery"), F.col("x.distance").alias("distance"), F.col("y.distance").alias("eager_distance"), F.col("y.battery").alias("eager_battery"), decisions.can_finish_strict(*car).alias("strict"), decisions.can_finish_floored(*car).alias("floored"))
