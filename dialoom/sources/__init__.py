"""Sources of the conversation engine."""
