"""Sources and sinks: driver tables, stand-in views, the answer log, JSON practice sets."""
