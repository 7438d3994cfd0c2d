"""Part of tallyforge: plans."""
