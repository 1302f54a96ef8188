"""Whole runs, registered queries and their SQL."""
