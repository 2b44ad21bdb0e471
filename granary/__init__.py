"""granary: a PySpark-native analytics engine for code, issue and runtime telemetry.

The core never imports the optional subpackage ``llm``.
"""

__version__ = "0.2.0"
