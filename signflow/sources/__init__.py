"""Readers and writers: files in, corpus DataFrames out, and back."""
