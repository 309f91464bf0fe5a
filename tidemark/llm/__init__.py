"""Training-data operators: encoding, mixing, privacy, quality, decontamination,
extraction, near-duplicate detection, language-model scoring, language id.

Every operator lives in a module of its own and works on DataFrames; ``queries``
holds the registered ``opN_*`` queries.  Nothing else of the library imports this
subpackage.
"""
