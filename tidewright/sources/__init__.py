"""Sources, sinks and table factories."""
