"""Plans of the conversation analytics engine."""
