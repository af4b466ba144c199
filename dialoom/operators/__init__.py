"""Operators of the conversation engine."""
