"""The daily revenue job over arriving files; nothing else here needs streaming state."""
