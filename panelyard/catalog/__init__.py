"""Registered queries on the driver tables, each next to its SQL oracle."""
