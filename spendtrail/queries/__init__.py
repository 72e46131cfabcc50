"""Named queries over the driver's tables, and their SQL."""

from spendtrail.queries import journeys, media

QUERIES = journeys.QUERIES | media.QUERIES
SQL = journeys.SQL | media.SQL
