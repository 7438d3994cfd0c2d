"""Part of tallyforge: operators."""
