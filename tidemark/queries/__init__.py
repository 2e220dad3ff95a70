"""Registered queries by area, each module with QUERIES and, where SQL can express them, ORACLE."""
