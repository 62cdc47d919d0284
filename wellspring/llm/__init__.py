"""Operators for preparing training text: filtering, duplicates, archives, mixing, packing and ordering."""
