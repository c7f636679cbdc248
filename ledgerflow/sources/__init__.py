"""Readers that hand the operators their input tables and streams."""
