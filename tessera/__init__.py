"""Tessera: DataFrame-to-DataFrame operators for preparing and evaluating
text datasets used in language-model post-training."""

__version__ = "0.1.0"
