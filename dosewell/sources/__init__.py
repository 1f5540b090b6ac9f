"""Readers and writers of the library's table layouts."""
