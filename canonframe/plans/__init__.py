"""Registered queries: the table bridge, the Spark plans and their SQL oracles."""
