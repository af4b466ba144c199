"""Plans of the conversation engine."""
