"""Tessera: exact market-data tables and training-data operators on Spark."""
