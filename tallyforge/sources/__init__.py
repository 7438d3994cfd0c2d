"""Part of tallyforge: sources."""
