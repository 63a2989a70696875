"""Readers and writers: tables, line files, tab-separated rows, interval files, logs, result documents."""
