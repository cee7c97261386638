"""Training-data operators: ten corpus-scale building blocks.

Nothing else in ``brindle`` imports this subpackage.  Every operator takes and
returns DataFrames; per-row work runs in Arrow batches over NumPy arrays, and
whatever crosses documents is a Spark join, aggregation or range sort.
"""
