"""Plans of the affiliation-network engine."""
