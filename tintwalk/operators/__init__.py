"""Relational operators of the logic. A relation has a column ``state``, a column ``colour`` and one column for each open name, and is a set."""
