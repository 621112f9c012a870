"""Training-data operators: packing, dedup, token counts, quality, PII, WARC, decontamination, sharding.

Nothing else in the package imports this subpackage; its queries are in ``queries.py``.
"""
