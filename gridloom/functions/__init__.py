"""Column functions, derived tables and what operators share."""
