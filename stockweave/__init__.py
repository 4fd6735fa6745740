"""Weekly demand, inventory and churn analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
