"""brindle: column, table and keyed-state operations for Spark."""
