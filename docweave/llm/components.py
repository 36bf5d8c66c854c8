"""Connected components, as the operators for training text use them."""

from docweave.operators.components import components

__all__ = ["components"]
