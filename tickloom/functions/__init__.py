"""Column expressions: no frame, no action, usable in any select."""
