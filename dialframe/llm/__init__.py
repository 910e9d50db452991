"""Training-data operators: dedup, filtering, formatting, packing and archiving of web text.

Nothing outside this subpackage imports it; ``queries.py`` lists its driver queries.
"""
