"""Plan-shaping helpers: durable intermediate tables and joins that survive hot keys."""
