"""Operations of a training-data pipeline: deduplication, filtering, packing, formatting.

Nothing else in the library imports this subpackage.
"""
