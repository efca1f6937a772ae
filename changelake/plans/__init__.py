"""Derived feeds, registered queries and their reference SQL."""
