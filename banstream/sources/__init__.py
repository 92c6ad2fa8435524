"""What is read and written: logs, rules, networks, ban state, actions."""
