"""Scalar building blocks: ids, paths, times, and predicates between file versions."""
