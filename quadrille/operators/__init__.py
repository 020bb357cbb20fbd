"""DataFrame operators over quads and solutions."""
