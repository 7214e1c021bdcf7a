"""Operators of a training-data pipeline: quality, decontamination, lists, tokens, joins, chat, privacy, shards, pages."""
