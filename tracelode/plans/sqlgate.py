"""Guarded read-only SQL over named tables."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S

# Expressions that reach outside the tables, by class, whatever name calls them, and functions that make rows.
DENIED = frozenset("CallMethodViaReflection TryReflect InputFileName InputFileBlockStart InputFileBlockLength CurrentUser CurrentDatabase CurrentCatalog SessionUser SparkVersion Version Uuid RaiseError RaiseErrorExpressionBuilder".split())
NAMES_OF_USERS = frozenset(("current_user", "session_user", "user"))
ROW_MAKERS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple range".split())
_READS = re.compile(r"Command|Statement|Insert|Create|Drop|Alter|Delete|Update|Merge|CompoundBody|Script|UnresolvedTableOrView|Describe|Show|Cache|Refresh|SetCatalog|SetVariable|Explain")


class Refused(ValueError):
    """A statement that the gate doesn't let through."""


def _walk(session, tree):
    """Every node of a parsed tree: plans, expressions, and what hangs in their fields, such as subqueries and WITH."""
    node_class = session._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.trees.TreeNode")  # noqa: SLF001
    product, several = (session._jvm.java.lang.Class.forName(n) for n in ("scala.Product", "scala.collection.Iterable"))  # noqa: SLF001
    todo = [tree]
    while todo:
        x = todo.pop()
        if not hasattr(x, "getClass"):  # numbers and text
            continue
        if node_class.isInstance(x):
            yield x
        parts = x.productIterator() if product.isInstance(x) else x.iterator() if several.isInstance(x) else None
        while parts is not None and parts.hasNext():
            todo.append(parts.next())


def _text(name) -> str:
    return ".".join(str(name.apply(i)) for i in range(name.size())).lower()


def _checked(session, tree) -> set[str]:
    """Names of the tables that a parsed tree reads; refuses what isn't a query or calls what isn't open to queries.

    A function is open if it is built in and its expression is not denied; names are taken from the
    tree, so that quotes and comments hide nothing.
    """
    state = session._jsparkSession.sessionState()  # noqa: SLF001
    names = set()
    for node in _walk(session, tree):
        kind = node.getClass().getSimpleName()
        if _READS.search(kind):
            raise Refused("one SELECT is expected")
        if kind == "UnresolvedRelation":
            names.add(_text(node.multipartIdentifier()))
        elif kind == "UnresolvedTableValuedFunction":
            if _text(node.name()) not in ROW_MAKERS:
                raise Refused(f"function {_text(node.name())} isn't open to queries")
        elif kind == "UnresolvedFunction":
            name = _text(node.nameParts())
            known = state.functionRegistry().lookupFunction(session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))  # noqa: SLF001
            if known.isEmpty() or known.get().getSource() != "built-in" or known.get().getClassName().rsplit(".", 1)[-1] in DENIED:
                raise Refused(f"function {name} isn't open to queries")
        elif kind == "UnresolvedAttribute" and _text(node.nameParts()) in NAMES_OF_USERS:  # a function where no column has the name
            raise Refused(f"{_text(node.nameParts())} isn't open to queries")
        elif kind.rstrip("$") in DENIED:
            raise Refused(f"{kind} isn't open to queries")
    return names


def _parsed(session, text: str, what: str):
    parser = session._jsparkSession.sessionState().sqlParser()  # noqa: SLF001
    try:
        return getattr(parser, what)(text)
    except Exception as e:
        raise Refused(f"it doesn't parse: {str(e).splitlines()[0][:200]}") from None


def check_sql(spark: SparkSession, sql: str, known=None) -> str:
    """One SELECT over ``known`` names (any, where none are given), as text; anything else is refused."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise Refused("one SELECT is expected")
    tables_of(spark, text, known)
    return text


def tables_of(spark: SparkSession, sql: str, known=None) -> set[str]:
    """Names that one SELECT reads, its own WITH names left out."""
    text = sql.strip().rstrip(";").strip()
    plan = _parsed(spark, text, "parsePlan")
    own = set()
    for node in _walk(spark, plan):
        if node.getClass().getSimpleName() == "UnresolvedWith":
            for i in range(node.cteRelations().size()):
                own.add(str(node.cteRelations().apply(i).productElement(0)).lower())
    names = _checked(spark, plan) - own
    if bad := [n for n in names if "." in n or known is not None and n not in known]:
        raise Refused(f"no table {sorted(bad)[0]}")
    return names


def check_filter(spark: SparkSession, condition: str) -> str:
    """A condition over columns only: the functions of ``check_sql``, and no subquery."""
    tree = _parsed(spark, condition, "parseExpression")
    plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")  # noqa: SLF001
    if _checked(spark, tree) or any(plan.isInstance(n) for n in _walk(spark, tree)):
        raise Refused("a filter reads no tables")
    return condition


def query_unlimited(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run one SELECT over the named tables in a session of its own, without a limit: for jobs, not for requests."""
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    text = check_sql(own, sql, {name.lower() for name in tables})
    for name, df in tables.items():
        _view(own, df, name)
    return own.sql(text)


def query_tables(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = 1000) -> DataFrame:
    """The same with at most ``limit`` rows."""
    if not 1 <= limit <= S.RESULT_CAP:
        raise Refused(f"limit must be 1 to {S.RESULT_CAP}")
    return query_unlimited(spark, sql, tables).limit(limit)


def _view(session: SparkSession, df: DataFrame, name: str) -> None:
    """A view belongs to the session that makes it; the plan is shared."""
    rows = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed())  # noqa: SLF001
    rows.createOrReplaceTempView(name)


def json_rows(df: DataFrame) -> list[dict]:
    """Result rows as JSON values: times as ISO text, decimals as text, bytes as hex; a non-finite number raises."""

    def value(v):
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("a result isn't finite")
        if isinstance(v, (datetime.date, datetime.datetime)):
            return v.isoformat()
        if isinstance(v, decimal.Decimal):
            return str(v)
        if isinstance(v, (bytes, bytearray)):
            return bytes(v).hex()
        if isinstance(v, dict):
            return {str(k): value(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [value(x) for x in v]
        return v

    rows = [{k: value(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]
    json.dumps(rows)
    return rows
