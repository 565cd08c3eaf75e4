"""Composite jobs: inputs, the full comparison, the award plan, the SQL surface and named analyses."""
