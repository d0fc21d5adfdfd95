"""Read-only SQL over the mounted views."""

import json
import threading
import time

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges

#: The kinds of plan that a query may be made of; every other one, commands and scripts among them, is refused.
PLANS = set(
    """Project Filter Aggregate Sort Join AsOfJoin LateralJoin GlobalLimit LocalLimit Offset Tail Distinct SubqueryAlias Union UnionLoop
    Intersect Except Generate Pivot Unpivot Range Window Sample OneRowRelation LocalRelation UnresolvedRelation UnresolvedWith
    UnresolvedHaving UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedSubqueryColumnAliases
    UnresolvedHint WithWindowDefinition ResolvedInlineTable Repartition RepartitionByExpression""".split()
)
#: Built-in functions that run other code, tell of the session or the files, or answer differently each time.
REFUSED_FUNCTIONS = set(
    """java_method reflect try_reflect rand randn random randstr uniform uuid shuffle monotonically_increasing_id spark_partition_id
    input_file_name input_file_block_start input_file_block_length current_user session_user user current_catalog
    current_database current_schema version raise_error python_worker_logs""".split()
)
MAX_ROWS, MAX_SECONDS = 5_000, 30.0


class Refused(ValueError):
    """The statement is no query, or it does more than read."""


def _parts(spark: SparkSession, root):
    """Every plan and expression of a parsed statement, wherever it hangs: children, subqueries, common tables, window definitions."""
    of = spark._jvm.java.lang.Class.forName
    node, product, several = (of(f"{n}") for n in ("org.apache.spark.sql.catalyst.trees.TreeNode", "scala.Product", "scala.collection.Iterable"))
    stack = [root]
    while stack:
        x = stack.pop()
        if not isinstance(x, JavaObject):
            continue
        if several.isInstance(x):
            each = x.iterator()
            while each.hasNext():
                stack.append(each.next())
        elif product.isInstance(x):
            if node.isInstance(x):
                yield x
            stack.extend(x.productElement(k) for k in range(x.productArity()))


def _names(seq) -> list[str]:
    return [seq.apply(k) for k in range(seq.size())]


def _check_function(spark: SparkSession, parts: list[str], registry: str) -> None:
    """Only Spark's own functions, under their own names, that have no side effects."""
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    state, name = spark._jsparkSession.sessionState(), parts[-1].lower()
    if name in REFUSED_FUNCTIONS or len(parts) > 1:
        raise Refused(f"the function {'.'.join(parts)} is not allowed")
    key = catalyst.FunctionIdentifier(name)
    own = getattr(catalyst.analysis, registry).builtin().lookupFunction(key)
    used = (state.functionRegistry() if registry == "FunctionRegistry" else state.tableFunctionRegistry()).lookupFunction(key)
    if own.isEmpty() or used.isEmpty() or own.get().getClassName() != used.get().getClassName():
        raise Refused(f"{name} is no built-in function")


def guard(spark: SparkSession, text: str) -> None:
    """Accept one statement that only reads views and tables, by built-in functions without side effects."""
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Refused(f"not one statement: {str(e)[:200]}") from None
    plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    for x in _parts(spark, root):
        kind = x.getClass().getSimpleName().rstrip("$")
        if plan.isInstance(x) and kind not in PLANS or "UnresolvedIdentifier" in kind:
            raise Refused(f"{kind} is not allowed")
        if kind == "UnresolvedRelation" and (len(names := _names(x.multipartIdentifier())) > 1 or "/" in names[-1]):
            raise Refused(f"{'.'.join(names)} is no name of a view")  # with a format before it, it would be a path
        if kind == "UnresolvedFunction":
            _check_function(spark, _names(x.nameParts()), "FunctionRegistry")
        elif kind == "UnresolvedTableValuedFunction":
            _check_function(spark, _names(x.name()), "TableFunctionRegistry")
        elif kind == "UnresolvedGenerator":
            _check_function(spark, [x.name().funcName()], "FunctionRegistry")


def readonly(spark: SparkSession, text: str) -> DataFrame:
    """The query as a DataFrame, if it only reads."""
    guard(spark, text)
    return spark.sql(text)


def run(spark: SparkSession, text: str, max_rows: int = MAX_ROWS, max_seconds: float = MAX_SECONDS) -> dict:
    """columns, rows (JSON values), row_count, truncated, seconds.

    At most one row over the cap is fetched; a query over the time is cancelled. NaN comes as null.
    """
    tag, began = f"readonly-{threading.get_ident()}-{time.monotonic_ns()}", time.monotonic()
    spark.addTag(tag)
    timer = threading.Timer(max_seconds, spark.interruptTag, [tag])
    timer.start()
    try:
        df = readonly(spark, text)
        names = df.columns
        plain = df.toDF(*[f"c{k}" for k in range(len(names))])  # columns may share a name
        doubles = {c for c, t in plain.dtypes if t in ("double", "float")}
        clean = plain.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in plain.columns])
        rows = [json.loads(x) for x in clean.limit(max_rows + 1).toJSON().collect()]
        rows = [{names[int(c[1:])]: v for c, v in r.items()} for r in rows]
    finally:
        timer.cancel()
        spark.removeTag(tag)
    shown = rows[:max_rows]
    return {"columns": names, "rows": shown, "row_count": len(shown), "truncated": len(rows) > max_rows, "seconds": time.monotonic() - began}


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def summarise(df: DataFrame, order: list[str], last: int = 5) -> DataFrame:
    """The last rows by ``order``, each with the number of all rows."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(last).withColumn("row_count", F.lit(df.count()).cast("long"))


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, values: list[str]) -> DataFrame:
    """Each left row with the ``values`` of the right's latest row of the same ``by`` not after its ``time``.

    Both sides are laid in one order and dealt to its ranges, and the last right row is carried on within a range and from
    range to range: no pairs, and no task with a whole ``by`` key. Right rows of one time should not be repeated.
    """
    carry = F.struct(*[F.col(v) for v in values])
    l_cols = [c for c in left.columns if c not in (by, time)]
    a = left.select(by, time, F.struct(*l_cols).alias("_l"), F.lit(None).cast(right.select(carry).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(by, time, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), carry.alias("_r"), F.lit(0).alias("_side"))
    dealt = ranges.in_ranges(a.unionByName(b), [by, time, "_side"])
    both = ranges.carried(dealt, by, [time, "_side"], "_r").where("_side = 1")
    return both.select(by, time, "_l.*", *[F.col("_r")[v].alias(v) for v in values])
