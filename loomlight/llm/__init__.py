"""Training-data operators: packing, deduplication, filtering, mixing, extraction and language identification.

Nothing else in the library imports this subpackage.
"""
