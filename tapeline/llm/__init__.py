"""Training-data operators: sharding, language, privacy, search, deduplication, tokens, quality, pages, leaks.

Nothing else in the library imports this subpackage; ``__spark_entry__`` registers its queries when it is present.
"""
