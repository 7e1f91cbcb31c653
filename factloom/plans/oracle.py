"""ANSI SQL (DuckDB dialect) twins of the derived inputs, used by
``oracle_sql()``: the same facts, damage rules and histories as
``factloom.sources.derived`` / ``factloom.plans.history``, written in SQL
over the driver's views, so each Spark query has an independent check.
"""

from __future__ import annotations

from factloom.functions.vocab import SYNTAXES
from factloom.sources.derived import RELATIONS


def _values(col: str, items) -> str:
    rows = ", ".join(f"('{x}')" for x in items)
    return f"(SELECT * FROM (VALUES {rows}) t({col}))"


REL_LIST = ", ".join(f"'{r}'" for r in RELATIONS)
RELS = _values("relation", RELATIONS)
ALL_SYNTAXES = _values("syntax", SYNTAXES)


def clean(x: str) -> str:
    return f"NULLIF(trim(replace({x}, '\"', ' ')), '')"


# Facts of every customer entity (long form) + canonical rank.
FACTS_CTES = f"""
ord AS (
  SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey),
prio AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
ent AS (
  SELECT c.c_custkey AS ex_id, 'Customer_' || CAST(c.c_custkey AS VARCHAR) AS ent,
         c.c_name, c.c_mktsegment, n.n_name, ord.first_order, ord.last_order
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN ord ON c.c_custkey = ord.o_custkey),
facts0 AS (
  SELECT ex_id, ent AS s, 'type' AS p, 'Customer' AS o, CAST(NULL AS VARCHAR) AS dt FROM ent
  UNION ALL SELECT ex_id, ent, 'label', {clean('c_name')}, 'xsd:string' FROM ent
  UNION ALL SELECT ex_id, ent, 'segment', {clean('c_mktsegment')}, 'xsd:string' FROM ent
  UNION ALL SELECT ex_id, ent, 'nation', {clean('n_name')}, 'xsd:string' FROM ent
  UNION ALL SELECT ex_id, ent, 'firstOrderDate', strftime(first_order, '%Y-%m-%d'), 'xsd:date' FROM ent
  UNION ALL SELECT ex_id, ent, 'firstOrderYear', CAST(year(first_order) AS VARCHAR), 'xsd:gYear' FROM ent
  UNION ALL SELECT ex_id, ent, 'lastOrderYear',
         CASE WHEN year(last_order) <> year(first_order) THEN CAST(year(last_order) AS VARCHAR) END,
         'xsd:gYear' FROM ent
  UNION ALL SELECT o_custkey, 'Customer_' || CAST(o_custkey AS VARCHAR), 'priority',
         {clean('o_orderpriority')}, 'xsd:string' FROM prio),
facts AS (
  SELECT ex_id, s, p, o, dt, CASE p WHEN 'type' THEN 0 WHEN 'label' THEN 1 ELSE 2 END AS rk
  FROM facts0 WHERE o IS NOT NULL),
pfacts AS (
  SELECT ex_id,
         CASE WHEN ex_id % 17 = 0 THEN 'Customer_' || CAST(ex_id + 1 AS VARCHAR) ELSE s END AS s, p,
         CASE WHEN ex_id % 7 = 0 AND p = 'label' THEN o || '-bis' ELSE o END AS o, dt, rk
  FROM facts WHERE NOT (ex_id % 11 = 0 AND p = 'segment')
  UNION ALL
  SELECT ex_id, CASE WHEN ex_id % 17 = 0 THEN 'Customer_' || CAST(ex_id + 1 AS VARCHAR) ELSE ent END,
         'priority', 'UNKNOWN', 'xsd:string', 2
  FROM ent WHERE ex_id % 5 = 0)"""


def with_facts(body: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {FACTS_CTES}{extra}\n{body}"


# Per-relation counts (A1) in SQL, from the facts and damage rules directly.
COUNTS_CTES = f"""
g AS (SELECT DISTINCT ex_id, p AS relation, o AS val FROM facts WHERE p IN ({REL_LIST})),
pr AS (SELECT DISTINCT ex_id, p AS relation, o AS val FROM pfacts
       WHERE p IN ({REL_LIST}) AND ex_id % 13 <> 0),
m AS (SELECT coalesce(g.ex_id, pr.ex_id) AS ex_id, coalesce(g.relation, pr.relation) AS relation,
             g.val AS gv, pr.val AS pv
      FROM g FULL JOIN pr ON g.ex_id = pr.ex_id AND g.relation = pr.relation AND g.val = pr.val),
e AS (SELECT ex_id, relation,
             count(*) FILTER (WHERE gv IS NOT NULL AND pv IS NOT NULL) AS hit,
             count(*) FILTER (WHERE gv IS NULL) AS miss,
             count(*) FILTER (WHERE gv IS NOT NULL) AS ng,
             count(*) FILTER (WHERE pv IS NOT NULL) AS np
      FROM m GROUP BY ex_id, relation),
x AS (SELECT relation,
        sum(CASE WHEN ng > 0 AND ex_id % 13 <> 0 THEN hit ELSE 0 END) AS tp,
        sum(CASE WHEN ng > 0 AND ex_id % 13 <> 0 THEN miss ELSE 0 END) AS fp,
        sum(CASE WHEN ng > 0 AND ex_id % 13 <> 0 AND np = 0 THEN 1 ELSE 0 END) AS fn,
        sum(hit) AS tp_strict, sum(miss) AS fp_strict, sum(ng - hit) AS fn_strict
      FROM e GROUP BY relation),
syn AS {ALL_SYNTAXES},
counts AS (
  SELECT s.syntax, r.relation,
         CAST(coalesce(x.tp, 0) AS BIGINT) AS tp, CAST(coalesce(x.fp, 0) AS BIGINT) AS fp,
         CAST(coalesce(x.fn, 0) AS BIGINT) AS fn,
         CAST(coalesce(x.tp_strict, 0) AS BIGINT) AS tp_strict,
         CAST(coalesce(x.fp_strict, 0) AS BIGINT) AS fp_strict,
         CAST(coalesce(x.fn_strict, 0) AS BIGINT) AS fn_strict
  FROM {RELS} r CROSS JOIN syn s LEFT JOIN x ON r.relation = x.relation)"""


def prf_sql(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p = f"(CASE WHEN {tp} > 0 THEN 100.0 * {tp} / ({tp} + {fp}) ELSE 0.0 END)"
    r = f"(CASE WHEN {tp} > 0 THEN 100.0 * {tp} / ({tp} + {fn}) ELSE 0.0 END)"
    f1 = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return p, r, f1


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"
