"""Operators for preparing training data: token counts, deduplication, URL
filters, byte-level BPE, chat formatting, fingerprints, packing and quality
rules.  Nothing else in the library imports this subpackage."""
