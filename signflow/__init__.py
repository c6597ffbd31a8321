"""Sequence-corpus analytics on Spark: DataFrame operators over ordered token arrays."""
