"""Training-data operators: archives, mixing, deduplication, filtering, packing.

Nothing else in the library imports this subpackage.
"""
