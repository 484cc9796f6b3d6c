"""Readers, writers and adapters that turn stored tables into event logs."""
