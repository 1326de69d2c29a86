"""Movement files as they arrive."""
