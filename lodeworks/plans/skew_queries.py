"""Per-key results of the listening log, whose keys are very uneven."""

from __future__ import annotations

from lodeworks.operators.skew import plays_by_key
from lodeworks.sources.tables import LOG, table

FIELDS = ["userid", "artid"]


def p4_plays(spark, sf_dir):
    return plays_by_key(table(spark, sf_dir, LOG), FIELDS)


def p4_found(spark, sf_dir):
    return p4_plays(spark, sf_dir).filter("heavy").select("field_name", "key_value")


QUERIES = {"p4_plays": p4_plays, "p4_found": p4_found}

_PLAYS = rf"""
WITH rows_once AS (SELECT DISTINCT * FROM {LOG}),
keyed AS (
  SELECT 'userid' AS field_name, lower(regexp_replace(userid, '^\s+|\s+$', '', 'g')) AS key_value FROM rows_once
  UNION ALL
  SELECT 'artid', lower(regexp_replace(artid, '^\s+|\s+$', '', 'g')) FROM rows_once
),
counts AS (SELECT field_name, key_value, count(*) AS plays FROM keyed WHERE key_value <> '' GROUP BY ALL)
"""
SQL = {
    "p4_plays": _PLAYS + "SELECT field_name, key_value, plays, plays > 0.01 * (SELECT count(*) FROM rows_once) AS heavy FROM counts",
    "p4_found": _PLAYS + "SELECT field_name, key_value FROM counts WHERE plays > 0.01 * (SELECT count(*) FROM rows_once)",
}
