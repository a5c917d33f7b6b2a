"""Functions of the conversation analytics engine."""
