"""Training-data operators: tokenising, deduplication, filtering, mixing, archives and search.

Nothing else in the library imports this subpackage; it may be deleted as a whole.
"""
