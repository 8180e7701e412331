"""Sources, sinks and remote clients."""
