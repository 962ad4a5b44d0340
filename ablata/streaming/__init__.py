"""Incremental forms of the marginal counts. An extension: the reference has no streams."""
