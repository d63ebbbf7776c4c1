"""Operators of a training-data pipeline: near duplicates, search, decontamination, packing, scores, files, shards."""
