"""All queries outside the training-data operators, and their SQL."""

from __future__ import annotations

from gatefold.plans import circuits, derived, exports, files, plugins, records, streams, tables, texts

QUERIES = {**circuits.QUERIES, **tables.QUERIES, **streams.QUERIES, **plugins.QUERIES, **exports.QUERIES, **files.QUERIES, **derived.QUERIES, **records.QUERIES, **texts.QUERIES}
ORACLE_SQL = {**circuits.ORACLE_SQL, **tables.ORACLE_SQL, **streams.ORACLE_SQL, **plugins.ORACLE_SQL, **exports.ORACLE_SQL, **files.ORACLE_SQL, **derived.ORACLE_SQL, **records.ORACLE_SQL, **texts.ORACLE_SQL}
