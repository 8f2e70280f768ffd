"""Operators for preparing training data: packing, decontamination, joins, scoring, extraction, fingerprints."""
