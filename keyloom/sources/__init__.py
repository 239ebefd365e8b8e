"""Where tables live: a versioned store, and the text dump format."""
