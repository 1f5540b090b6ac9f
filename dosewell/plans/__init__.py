"""Registered queries by section, each with the SQL that it must agree with where SQL can express it."""
