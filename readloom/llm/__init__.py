"""Training-data operators: mixing, search, token files, near-duplicate removal, scoring, packing, archives.

Nothing outside this subpackage imports it.
"""
