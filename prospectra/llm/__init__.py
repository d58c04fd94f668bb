"""Training-data operators (sharding, de-duplication, extraction, quality, tokenising).

Nothing else in the library imports this subpackage.
"""
