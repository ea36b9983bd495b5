"""Registered queries (the driver contract) grouped by subject."""
