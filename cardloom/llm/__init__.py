"""Corpus operators for training data: deduplication, filtering, privacy, packing and scoring.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; work inside tasks is vectorised over Arrow buffers.
"""
