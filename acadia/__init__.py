"""acadia: course-and-partner-programme analytics as plain Spark DataFrame functions.

Layout
------
- ``sources``   table readers with explicit schemas, fixture inputs built from the driver tables
- ``functions`` reusable column/DataFrame helpers (filters, paging, latest-per-key, money, text)
- ``operators`` the reports (items 1-24) and set-at-a-time data jobs (items 25-46)
- ``streaming`` Structured Streaming jobs (items 47-48)
- ``plans``     named, parameterised queries over the fixtures plus their DuckDB oracle SQL

Every operator is ``(DataFrame..., params) -> DataFrame``: pure, lazy, no action inside,
and takes its clock as an explicit ``as_of`` argument.
"""

__version__ = "0.1.0"
