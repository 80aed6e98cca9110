"""The five classifiers, their stack, and scoring."""
