"""Binding of the library to the benchmark tables, the registered queries, and their SQL."""
