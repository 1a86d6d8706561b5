"""Training-data operators: fingerprints, packing, decontamination, counts, language, licences,
page text, near duplicates, toxicity and binary token files.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries.
"""
