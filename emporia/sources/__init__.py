"""Sources: role bindings (physical tables -> role DataFrames) and I/O."""
