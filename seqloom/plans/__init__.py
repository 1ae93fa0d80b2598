"""Plan helpers: reading tables, cutting lineage, salting."""
