"""Training-data operators: packing, scoring, filtering, deduplication, mixing and archives.

Nothing outside this subpackage imports it.
"""
