"""pulsewatch: API-request telemetry analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function; nothing is collected to the driver.  The same functions serve batch
and Structured Streaming plans.
"""

__version__ = "0.1.0"
