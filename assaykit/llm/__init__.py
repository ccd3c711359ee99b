"""Training-data operators: language ID, sharding, near-duplicates, licences,
decontamination, quality bands, personal data, WARC, packing and token files.

Nothing outside this subpackage imports it.
"""
