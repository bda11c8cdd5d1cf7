"""Operators for large training corpora: near-duplicates, quality, tokens, packing, licences.

Nothing outside this folder imports it.
"""
