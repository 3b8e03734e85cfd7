"""Sources: scans of repositories, source files, interface descriptions and spans, as entity and relationship rows."""
