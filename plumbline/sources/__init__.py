"""Where entities and query specs come from."""
