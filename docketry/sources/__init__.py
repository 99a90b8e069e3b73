"""Readers and writers of case files, caches, state files and logs."""
