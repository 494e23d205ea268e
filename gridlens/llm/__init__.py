"""Training-data operators; nothing else in the library imports this subpackage."""
