"""Column functions: metrics, metadata, identifiers, SQL registration."""
