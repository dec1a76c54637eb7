"""Operators for preparing training text: archives, shards, token files, filters, joins and scores."""
