"""Question catalogue, query registry and oracle SQL."""
