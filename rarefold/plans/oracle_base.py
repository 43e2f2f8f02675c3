"""SQL building blocks for the DuckDB oracle (hand-written, independent of the Spark code)."""

OBS = """obs AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                        CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_id,
         l_quantity AS qty,
         CASE WHEN l_linenumber = 7 AND l_discount = 0 THEN CAST(NULL AS DOUBLE) ELSE l_extendedprice END AS price,
         l_discount AS disc,
         l_tax AS tax,
         CAST(l_linenumber AS INTEGER) AS line,
         CASE WHEN l_returnflag = 'R' AND l_quantity >= 41 AND l_discount >= 0.05 THEN 'yes' ELSE 'no' END AS failure,
         l_returnflag AS returnflag,
         l_linestatus AS linestatus,
         l_extendedprice AS extprice,
         l_suppkey AS suppkey
  FROM lineitem)"""

REASON = """nullif(concat_ws('; ',
    CASE WHEN qty IS NULL THEN 'qty=None incumple not_nullable' END,
    CASE WHEN qty < 0.0 THEN 'qty=' || CAST(qty AS VARCHAR) || ' incumple greater_than_or_equal_to(0.0)' END,
    CASE WHEN qty > 49.0 THEN 'qty=' || CAST(qty AS VARCHAR) || ' incumple less_than_or_equal_to(49.0)' END,
    CASE WHEN price < 0.0 THEN 'price=' || CAST(price AS VARCHAR) || ' incumple greater_than_or_equal_to(0.0)' END,
    CASE WHEN disc IS NULL THEN 'disc=None incumple not_nullable' END,
    CASE WHEN disc < 0.0 THEN 'disc=' || CAST(disc AS VARCHAR) || ' incumple greater_than_or_equal_to(0.0)' END,
    CASE WHEN disc > 1.0 THEN 'disc=' || CAST(disc AS VARCHAR) || ' incumple less_than_or_equal_to(1.0)' END,
    CASE WHEN tax IS NULL THEN 'tax=None incumple not_nullable' END,
    CASE WHEN tax < 0.0 THEN 'tax=' || CAST(tax AS VARCHAR) || ' incumple greater_than_or_equal_to(0.0)' END,
    CASE WHEN tax > 1.0 THEN 'tax=' || CAST(tax AS VARCHAR) || ' incumple less_than_or_equal_to(1.0)' END,
    CASE WHEN line IS NULL THEN 'line=None incumple not_nullable' END,
    CASE WHEN line < 1.0 THEN 'line=' || CAST(line AS VARCHAR) || ' incumple greater_than_or_equal_to(1.0)' END,
    CASE WHEN line > 7.0 THEN 'line=' || CAST(line AS VARCHAR) || ' incumple less_than_or_equal_to(7.0)' END,
    CASE WHEN failure IS NULL THEN 'failure=None incumple not_nullable' END,
    CASE WHEN failure NOT IN ('yes', 'no') THEN 'failure=''' || failure || ''' incumple isin([''yes'', ''no''])' END
  ), '')"""

TAGGED = f"tagged AS (SELECT *, {REASON} AS quarantine_reason FROM obs)"

VALID = "valid AS (SELECT * FROM tagged WHERE quarantine_reason IS NULL)"

SCORE = "round(1 / (1 + exp(-(-5.5 + 0.08 * qty + 25 * disc))), 4)"

SCORED = f"scored AS (SELECT row_id, CASE WHEN failure = 'yes' THEN 1 ELSE 0 END AS y, {SCORE} AS score FROM valid)"

LONG = """lng AS (
  SELECT row_id, failure, 'qty' AS attr, qty AS v FROM valid
  UNION ALL SELECT row_id, failure, 'price', price FROM valid
  UNION ALL SELECT row_id, failure, 'disc', disc FROM valid
  UNION ALL SELECT row_id, failure, 'tax', tax FROM valid
  UNION ALL SELECT row_id, failure, 'line', CAST(line AS DOUBLE) FROM valid)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = with_(OBS, TAGGED, VALID)
