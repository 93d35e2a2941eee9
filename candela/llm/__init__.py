"""Training-data operators: deduplication, language ID, PII, mixing, packing and friends.

Nothing outside this folder imports it; ``__spark_entry__`` registers its queries only when it is present.
"""
