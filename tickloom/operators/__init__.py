"""DataFrame operators over bars: each takes a frame keyed by (symbol, i) and adds columns, or derives a child frame."""
