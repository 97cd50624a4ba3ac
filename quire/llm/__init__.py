"""Training-data operators: one module per operator, plus ``registry`` with their queries and SQL.

Nothing outside this subpackage imports it.
"""
