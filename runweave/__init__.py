"""Analytics of agent-run traces on Spark."""
