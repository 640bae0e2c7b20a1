"""Sources and sinks of archives."""
