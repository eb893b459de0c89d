"""Plans: the registry of named queries and their independent SQL twins."""
