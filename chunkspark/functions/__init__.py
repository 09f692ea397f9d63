"""Column helpers, plain-Python cores, and the interfaces of embedding and vision backends."""
