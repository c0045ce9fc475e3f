"""Training-data operators.

Each operator keeps its own module and a general interface; ``queries`` holds
the thin registered queries and ``sql`` the DuckDB statements they match.
Nothing outside this subpackage imports it.
"""
