"""Sources and sinks: driver tables, adapters, raw-file readers, writers."""
