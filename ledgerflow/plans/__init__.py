"""Compositions of operators into whole jobs and registered queries."""
