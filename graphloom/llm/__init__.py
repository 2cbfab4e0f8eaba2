"""Training-data operators: dedup, quality, tokens, media, toxicity, HTML and packing.

Nothing else in the library imports this subpackage.
"""
