"""DataFrame operators grouped by survey section."""
