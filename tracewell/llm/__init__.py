"""Operators for preparing training text: packing, filtering, formatting, deduplication and decontamination."""
