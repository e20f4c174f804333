"""The stages in order, and the registered queries with their SQL twins."""
