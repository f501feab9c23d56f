"""Reports and tables of findings."""
