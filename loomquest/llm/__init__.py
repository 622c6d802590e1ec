"""Operators for large training corpora. Nothing else in loomquest imports this subpackage."""
