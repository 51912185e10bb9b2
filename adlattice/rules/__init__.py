"""Rule tables as plain data; operators take others in their place."""
