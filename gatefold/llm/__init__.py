"""Operators for preparing training data: decontamination, packing, dedup, sharding, classifiers, filters, archives, media."""
