"""The demonstration programs: ``python -m brindle.plans.demo [books | rna | guess NUMBER]``."""

from __future__ import annotations

import random
import sys

from pyspark.sql import functions as F

from ..functions import text
from ..operators import iterative, relational, stateful
from ..session import local_session
from ..sources import demo_books


def books(spark) -> list[str]:
    store = demo_books(spark)
    value = relational.inventory_value(store, "price", "in_stock").first()[0]
    show = lambda b: f"{b.title} by {b.author} - price: ${b.price:.2f}, in stock: {b.in_stock}"
    out = [f"Total inventory value: ${value}"]
    title = "The Go Programming Language"
    found = relational.find_first(store, F.col("title") == title, "ins_seq").withColumn("after", stateful.sell_one("in_stock")).collect()
    out += [f"Found book: {show(b)}; remaining after a sale: {b.after.in_stock}" for b in found] or [f"no book with title {title}"]
    return out + [f"Found book: {show(b)}" for b in relational.find_containing(store, "title", "Go").orderBy("ins_seq").collect()]


def main(args: list[str]) -> None:
    what = args[0] if args else "books"
    if what == "guess":
        if len(args) < 2 or not args[1].isdecimal() or not 1 <= int(args[1]) <= 100:
            print("a whole number from 1 to 100 is needed")
            return
        trace = iterative.guess_trace(int(args[1]), random.randrange(1 << 30))
        print("\n".join(f"guess {i}: {g}" for i, g in enumerate(trace, 1)))
        return
    spark = local_session("demo")
    print("\n".join(books(spark)) if what == "books" else spark.range(1).select(text.to_rna(F.lit("GCTA"))).first()[0])


if __name__ == "__main__":
    main(sys.argv[1:])
