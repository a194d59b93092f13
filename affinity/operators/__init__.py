"""Operators of the affiliation-network engine."""
