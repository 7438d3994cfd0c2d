"""Part of tallyforge: streaming."""
