"""Connected components, as the other operators use them."""

from tidemark.operators.graph import components  # noqa: F401
