"""Training-data operators: deduplication, packing, filtering, media and scans.

Each module holds one operator with its own general interface; the thin
``opN_<name>`` queries that derive digest columns live in ``queries``.
"""
