"""Functions of the conversation engine."""
