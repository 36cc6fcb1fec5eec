"""Training-data operators: search, dedup, filtering, mixing, packing, formatting.

Each module holds one operator with a general DataFrame interface plus the thin
``opN_<name>`` query over the driver's tables.  ``registry`` collects the queries.
"""
