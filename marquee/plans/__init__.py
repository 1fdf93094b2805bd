"""Entity views over the input tables and the registry of named queries."""
