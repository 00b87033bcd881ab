"""Rule-driven computations: calendars, deadlines, rule choice and evidence states."""
