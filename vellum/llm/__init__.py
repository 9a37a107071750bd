"""Training-data operators: near-duplicate removal, extraction, filtering, mixing, packing and token output.

Nothing else in the library imports this subpackage.
"""
