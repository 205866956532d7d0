"""Readers and writers: tables, rules, attribute sets, jobs, examples."""
