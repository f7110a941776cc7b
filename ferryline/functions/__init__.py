"""Column functions with the semantics of the source database."""
