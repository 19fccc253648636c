"""Ledger analytics expressed as Spark DataFrame transformations."""
