"""Options, configuration and the composed plan."""
