"""Queries of inventory D: cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean as C
from tidemark.plans.bindings import Data
from tidemark.plans.registry import n, query, r
from tidemark.specs import CleaningStep, Predicate

# line items with a missing discount, checked with every predicate of the language
_LINES = """ln AS (SELECT *, nullif(l_discount, 0.05) AS disc FROM lineitem)"""
_CASES = {
    "eq": (Predicate("l_returnflag", "==", "R"), "l_returnflag = 'R'"),
    "ne": (Predicate("disc", "!=", 0.04), "coalesce(disc <> 0.04, TRUE)"),
    "lt": (Predicate("disc", "<", 0.04), "coalesce(disc < 0.04, FALSE)"),
    "le": (Predicate("l_quantity", "<=", "10"), "l_quantity <= 10"),
    "gt": (Predicate("disc", ">", "l_tax"), "coalesce(disc > l_tax, FALSE)"),
    "ge": (Predicate("l_quantity", ">=", 25), "l_quantity >= 25"),
    "isna": (Predicate("disc", "isna"), "disc IS NULL"),
    "notna": (Predicate("disc", "notna"), "disc IS NOT NULL"),
    "isin": (Predicate("l_returnflag", "isin", ("A", "N")), "l_returnflag IN ('A', 'N')"),
    "notin": (Predicate("disc", "notin", (0.01, 0.02)), "coalesce(disc NOT IN (0.01, 0.02), TRUE)"),
    "before": (Predicate("l_shipdate", "before", "1996-06-01"), "l_shipdate < TIMESTAMP '1996-06-01'"),
    "on_or_after": (Predicate("l_shipdate", "on_or_after", "1999-01-01"), "l_shipdate >= TIMESTAMP '1999-01-01'"),
    "gtcol": (Predicate("disc", ">col", "l_tax"), "coalesce(disc > l_tax, FALSE)"),
    "ltcol": (Predicate("disc", "<col", "l_tax"), "coalesce(disc < l_tax, FALSE)"),
}


def _lines(x: Data):
    return x.t("lineitem").withColumn("disc", F.nullif(F.col("l_discount"), F.lit(0.05)))


@query("d1_predicate", f"""WITH {_LINES} SELECT {', '.join(n(f'count(*) FILTER ({sql})', k) for k, (_, sql) in _CASES.items())},
{n("count(*) FILTER (l_returnflag = 'R' AND coalesce(disc < 0.04, FALSE))", 'both')} FROM ln""")
def _(x: Data):
    df = _lines(x)
    def count(where):
        return F.count(F.when(C.predicate(df, where), 1))
    both = [_CASES["eq"][0], _CASES["lt"][0]]
    return df.agg(*[count([p]).alias(k) for k, (p, _) in _CASES.items()], count(both).alias("both"))


_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("d2_drop_duplicates", f"""SELECT {n('l_orderkey', 'l_orderkey')}, {n('l_linenumber', 'l_linenumber')},
{n('l_partkey', 'l_partkey')}, {r('l_quantity', 'l_quantity')} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ORDER)}) = 1""")
def _(x: Data):
    return C.drop_duplicates(x.t("lineitem"), ["l_orderkey", "l_linenumber"], _ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_OVER = (Predicate("disc", ">col", "l_tax"),)


@query("d3_drop_rows", f"""WITH {_LINES} SELECT {n('l_orderkey', 'l_orderkey')}, {n('l_partkey', 'l_partkey')}, {r('disc', 'disc')}
FROM ln WHERE NOT coalesce(disc > l_tax, FALSE)""")
def _(x: Data):
    return C.drop_rows(_lines(x), _OVER).select("l_orderkey", "l_partkey", "disc")


@query("d3_flag_rows", f"""WITH {_LINES} SELECT {n('l_orderkey', 'l_orderkey')}, {n('l_partkey', 'l_partkey')},
coalesce(disc > l_tax, FALSE) AS over_tax FROM ln""")
def _(x: Data):
    return C.flag_rows(_lines(x), _OVER, "over_tax").select("l_orderkey", "l_partkey", "over_tax")


@query("d4_missing_indicator", f"""WITH {_LINES} SELECT {n('l_orderkey', 'l_orderkey')}, {n('l_partkey', 'l_partkey')},
disc IS NULL OR nullif(l_tax, 0.02) IS NULL AS gap FROM ln""")
def _(x: Data):
    df = _lines(x).withColumn("tax", F.nullif(F.col("l_tax"), F.lit(0.02)))
    return C.missing_indicator(df, ["disc", "tax"], "gap").select("l_orderkey", "l_partkey", "gap")


@query("d5_preview", f"""WITH {_LINES} SELECT 'drop_rows' AS op, 'lineitem' AS "table", {n('count(*)', 'rows_before')},
{n('count(*) FILTER (NOT coalesce(disc > l_tax, FALSE))', 'rows_after')},
{n('count(*) FILTER (disc > l_tax)', 'rows_affected')}, {r('count(*) FILTER (disc > l_tax) / count(*)', 'share')},
'removed' AS effect FROM ln""")
def _(x: Data):
    return C.preview(_lines(x), CleaningStep("drop_rows", "lineitem", where=_OVER))


@query("d5_preview_examples", f"""SELECT {n('l_orderkey', 'l_orderkey')}, {n('l_linenumber', 'l_linenumber')},
{n('l_partkey', 'l_partkey')} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY l_partkey) > 1 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 5""")
def _(x: Data):
    df = x.t("lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    step = CleaningStep("drop_duplicates", "lineitem", ("l_orderkey", "l_linenumber"), order_by=("l_partkey",))
    return C.preview_examples(df, step)


_STEPS = (
    CleaningStep("drop_duplicates", "lineitem", ("l_orderkey", "l_linenumber"), order_by=tuple(_ORDER)),
    CleaningStep("drop_rows", "lineitem", where=(Predicate("l_quantity", "<", 3),)),
    CleaningStep("flag_rows", "lineitem", where=_OVER, flag_name="over_tax"),
    CleaningStep("missing_indicator", "orders", ("status",), flag_name="no_status"),
)
_STEP_SQL = f"""{_LINES},
s0 AS (SELECT * FROM ln QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ORDER)}) = 1),
s1 AS (SELECT * FROM s0 WHERE NOT l_quantity < 3)"""


def _tables(x: Data):
    o = x.t("orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return {"lineitem": _lines(x), "orders": o}


def _effect(step: int, op: str, table: str, before: str, affected: str, removed: bool) -> str:
    after = f"{before} - {affected}" if removed else before
    return f"""SELECT {n(str(step), 'step')}, '{op}' AS op, '{table}' AS "table", {n(before, 'rows_before')},
{n(after, 'rows_after')}, {n(affected, 'rows_affected')}, {r(f'{affected} / {before}', 'share')},
'{'removed' if removed else 'flagged (kept)'}' AS effect"""


@query("d6_recipe_effects", f"WITH {_STEP_SQL} " + "\nUNION ALL ".join([
    _effect(0, "drop_duplicates", "lineitem", "(SELECT count(*) FROM ln)",
            "((SELECT count(*) FROM ln) - (SELECT count(*) FROM s0))", True),
    _effect(1, "drop_rows", "lineitem", "(SELECT count(*) FROM s0)", "(SELECT count(*) FROM s0 WHERE l_quantity < 3)", True),
    _effect(2, "flag_rows", "lineitem", "(SELECT count(*) FROM s1)", "(SELECT count(*) FROM s1 WHERE disc > l_tax)", False),
    _effect(3, "missing_indicator", "orders", "(SELECT count(*) FROM orders)",
            "(SELECT count(*) FROM orders WHERE o_orderstatus = 'P')", False)]))
def _(x: Data):
    return C.run_recipe(_tables(x), _STEPS)[1]


@query("d6_recipe_table", f"""WITH {_STEP_SQL} SELECT {n('l_orderkey', 'l_orderkey')}, {n('l_linenumber', 'l_linenumber')},
{n('l_partkey', 'l_partkey')}, coalesce(disc > l_tax, FALSE) AS over_tax FROM s1""")
def _(x: Data):
    return C.run_recipe(_tables(x), _STEPS)[0]["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "over_tax")


# defects planted in the orders: copies of some, and a price that was multiplied
_PLANTED = """bad AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS price
  FROM orders UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100
  ELSE o_totalprice END FROM orders WHERE o_orderkey % 50 = 0)"""


def _planted(x: Data):
    o = x.t("orders", "o_orderkey", "o_custkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice"))
    o = o.select("o_orderkey", "o_custkey", price.alias("price"))
    return o.unionByName(o.where(F.col("o_orderkey") % 50 == 0))


@query("d7_recipe_verdict", f"""WITH {_PLANTED}, clean AS (SELECT DISTINCT * FROM bad)
SELECT 0::BIGINT AS duplicates_left, {n('count(*) FILTER (o_orderkey % 97 = 0)', 'defect_rows_kept')},
{n('count(*) FILTER (o_orderkey % 97 = 0 AND price <= 600000)', 'defect_rows_unhandled')},
{n('(SELECT count(*) FROM bad) - count(*)', 'rows_dropped')},
{n('greatest(0, (SELECT count(*) FROM bad) - count(*) - 10)', 'rows_dropped_beyond_defects')},
count(*) FILTER (o_orderkey % 97 = 0 AND price <= 600000) = 0 AS fixed FROM clean""")
def _(x: Data):
    before = _planted(x)
    steps = (CleaningStep("drop_duplicates", "orders", ("o_orderkey", "o_custkey", "price"), order_by=("price",)),
             CleaningStep("flag_rows", "orders", where=(Predicate("price", ">", 600000),), flag_name="too_high"))
    after = C.run_recipe({"orders": before}, steps)[0]["orders"]
    defects = before.where(F.col("o_orderkey") % 97 == 0).select("o_orderkey")
    return C.recipe_verdict(before, after, defects, ["o_orderkey"], ["too_high"], 10)
