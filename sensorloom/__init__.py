"""Recording-aware sensor time-series analytics as Spark DataFrame plans."""

from sensorloom.config import BaselineSpec, BootstrapSpec, WindowSpec

__all__ = ["BaselineSpec", "BootstrapSpec", "WindowSpec"]
