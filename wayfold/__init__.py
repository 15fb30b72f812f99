"""wayfold: a PySpark library for trajectory, sensor and station analytics."""

__version__ = "0.1.0"
