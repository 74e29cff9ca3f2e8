"""quorum — survey-distribution operators on Spark SQL.

Every operator is a function ``DataFrame -> DataFrame`` (or a ``Column``
builder) so Catalyst sees one declarative plan per query.
"""

from quorum.session import get_spark, checkpoint_dir  # noqa: F401
