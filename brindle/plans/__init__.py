"""Registered queries over the driver tables, with SQL that states the same result."""
