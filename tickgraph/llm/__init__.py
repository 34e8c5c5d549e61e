"""Training-data operators: near-duplicates, packing, scans, classifiers, repeated passages.

Nothing else in the library imports this subpackage.
"""
