"""Table sources, the result store and report sinks."""
