"""Operations of a training-data pipeline: fingerprints, packing, mixing, redaction, near-duplicates, formatting and models.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
