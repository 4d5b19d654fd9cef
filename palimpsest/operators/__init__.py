"""Operators: DataFrames in, DataFrames out. They run no actions; clocks, ids and pages are arguments.

A file list has path, id, size, updated (ms) and chunks (ids in order); `ordinal` where its order matters.
"""
