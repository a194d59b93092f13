"""Sources of the affiliation-network engine."""
