"""Relational operators: matching, timelines, live muting, manifests."""
