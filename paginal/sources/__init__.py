"""Sources and sinks: book databases, stored tables."""
