"""Palimpsest: snapshot, merge and transfer analytics for versioned files, on PySpark DataFrames."""
