"""fairline: match results and bookmaker prices turned into checked probabilities on Spark."""

__version__ = "0.1.0"
