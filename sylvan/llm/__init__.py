"""Operators for preparing training data: sanitising, encoding, scoring, packing, deduplicating.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library whole.
"""
