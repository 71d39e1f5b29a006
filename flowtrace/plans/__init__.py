"""Dashboard recipes, registered queries and their SQL oracles."""
