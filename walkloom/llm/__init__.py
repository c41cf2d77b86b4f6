"""Operators for preparing large text corpora. Nothing else in walkloom imports this subpackage."""
