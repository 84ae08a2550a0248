"""Training-data operators (numbered 1 to 13) and their registered queries.

Nothing outside this folder imports it; ``queries.py`` is the table of
registered queries. Each operator module documents its method, the cases it
defines (nulls, empty texts, ties, repeated rows) and its parameters.
"""
