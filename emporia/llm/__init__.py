"""Training-data operators: secret scans, WARC bundles, near-duplicates, BPE, packing and filters.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface and the thin ``query(spark, sf_dir)``
registered in ``queries.py``.
"""
