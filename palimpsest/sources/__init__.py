"""Sources and sinks: folders, object stores, and the tables of a repository."""
