"""Worked analyses of single datasets, composed of the operators: one module per dataset."""
