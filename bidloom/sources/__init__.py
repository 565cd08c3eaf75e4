"""Reading replies, documents and catalogues; writing the comparison."""
