"""Readers: files, tracker documents, key maps, logs, cycles."""
