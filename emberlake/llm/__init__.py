"""Training-data operators: joins, scans, packing, archives, mixing and scoring.

Nothing outside this subpackage imports it.
"""
