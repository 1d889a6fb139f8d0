"""Operators for preparing training corpora. Nothing else in docloom imports this subpackage."""
