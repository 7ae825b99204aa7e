"""Training-data operators: packing, near-duplicates, token counts, search, quality, token files,
media columns, secrets, BPE and licences. Nothing else in the library imports this subpackage."""
