"""DataFrame operators; each module is one family."""
