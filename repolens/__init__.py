"""repolens: repository-health analytics and request-log replay on Spark."""

__version__ = "0.1.0"
