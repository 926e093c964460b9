"""Plans: the hourly roll-up and the named-query registry (with oracle SQL)."""
