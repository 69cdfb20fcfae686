"""Training-data operators: quality, tokens, shards, decontamination, extraction, privacy,
fingerprints, near duplicates, language-model scores and URL rules.

Nothing outside this folder imports it; it imports nothing from the rest of the library.
"""
