"""Collections and their search plan."""
