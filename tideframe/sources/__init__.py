"""Readers and writers. Tables hold all groups, with the group as a column; facts are stored once."""
