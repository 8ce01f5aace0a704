"""Queries over the contract tables, each with its SQL."""
