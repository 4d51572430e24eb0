"""Readers and writers of the tables and files around the chain."""
