"""Column builders: durations, dates, addresses, ban times and texts."""
