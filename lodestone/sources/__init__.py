"""Sources and sinks: chunk tables, configuration files, keyed writes, row formats."""
