"""Functions of the affiliation-network engine."""
