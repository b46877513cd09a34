"""Physical building blocks: block joins, distributed ranks and bounded broadcasts."""
