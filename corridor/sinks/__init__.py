"""Writers of the domain's files: documents are lines in order, written as text by many tasks."""
