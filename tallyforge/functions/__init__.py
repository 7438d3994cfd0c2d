"""Part of tallyforge: functions."""
