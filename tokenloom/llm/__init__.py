"""Training-data operators: quality, deduplication, scans, packing, scoring, archives.

Nothing else in the library imports this folder; its queries are in ``queries``.
"""
