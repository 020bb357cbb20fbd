"""Sources and sinks of quads."""
