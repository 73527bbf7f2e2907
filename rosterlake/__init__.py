"""rosterlake: people-profile search and analytics as lazy Spark plans."""

__version__ = "0.1.0"
