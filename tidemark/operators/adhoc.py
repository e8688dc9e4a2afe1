"""Read-only SQL with paging, and metrics defined by an expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.thresholds import classify_metric, metric_threshold

# Plan nodes of the parser that only read.
PARSED_NODES = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator "
    "Pivot Project Sample Sort SubqueryAlias Tail Transpose Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith WithWindowDefinition RepartitionByExpression "
    "Repartition RebalancePartitions AsOfJoin".split()
)
# Plan nodes that the analyzer makes of them.
ANALYZED_NODES = PARSED_NODES | frozenset(
    "CTERelationDef CTERelationRef DataSourceV2Relation Expand HiveTableRelation LogicalRelation Range ResolvedHint ResolvedInlineTable UnionLoop "
    "UnionLoopRef Window WithCTE".split()
)
# Commands that only read, and the names they hold.
READ_COMMANDS = frozenset(
    "CurrentNamespace DescribeColumn DescribeFunction DescribeNamespace DescribeQueryCommand DescribeRelation ExplainCommand ShowColumns "
    "ShowCreateTable ShowCurrentNamespaceCommand ShowFunctions ShowNamespaces ShowNamespacesCommand ShowPartitions ShowTableExtended "
    "ShowTableProperties ShowTables ShowTablesExtended ShowViews UnresolvedFunctionName UnresolvedNamespace UnresolvedTable UnresolvedTableOrView".split()
)
# Functions that may stand for a table.
TABLE_FUNCTIONS = frozenset(
    "explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer range stack variant_explode variant_explode_outer".split()
)
# Functions that call any static method of the JVM, or read a descriptor file.
REACHING_FUNCTIONS = frozenset("from_protobuf java_method reflect to_protobuf try_reflect".split())
# Expressions of the same kind, and names that are only known when the statement runs.
REACHING_EXPRESSIONS = frozenset("CallMethodViaReflection ExpressionWithUnresolvedIdentifier TryReflect".split())
# Where Spark's own expressions live; those of other packages can do anything.
EXPRESSION_PACKAGES = ("org.apache.spark.sql.catalyst.analysis.", "org.apache.spark.sql.catalyst.expressions.")


class ReadOnlyQueryError(ValueError):
    """The statement is no single read-only query."""


def _kind(tree) -> str:
    """The class name of a node, without the mark of Scala's single objects."""
    return tree.getClass().getSimpleName().rstrip("$")


def _each(items) -> Iterator:
    for i in range(items.size()):
        yield items.apply(i)


def _nodes(plan) -> Iterator:
    """All nodes of a plan with those of CTEs and subqueries; a view counts as a table, so what it reads is left out."""
    yield plan
    if _kind(plan) == "View":
        return
    if _kind(plan) == "DescribeQueryCommand":
        yield from _nodes(plan.plan())
    for group in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for node in _each(group):
            if hasattr(node, "treeString"):
                yield from _nodes(node)


def _refuse_expression(tree) -> None:
    """Refuse an expression with a part that reaches beyond its input."""
    kind, package = _kind(tree), tree.getClass().getName()
    if kind in REACHING_EXPRESSIONS or not package.startswith(EXPRESSION_PACKAGES):
        raise ReadOnlyQueryError(f"Forbidden expression '{kind}'.")
    if kind == "UnresolvedFunction" and tree.nameParts().last().lower() in REACHING_FUNCTIONS:
        raise ReadOnlyQueryError(f"Forbidden function '{tree.nameParts().last().lower()}'.")
    for part in _each(tree.children()):
        _refuse_expression(part)


def _refuse_relation(spark: SparkSession, node) -> None:
    """Refuse relations that are files or streams, and functions that stand for other relations."""
    kind = _kind(node)
    if kind == "UnresolvedRelation":
        # A name of several parts that is no table would be tried as source.`path`.
        if node.multipartIdentifier().size() > 1 and not spark.catalog.tableExists(node.tableName()):
            raise ReadOnlyQueryError(f"Unknown table '{node.tableName()}'. Files can't be queried.")
        if node.isStreaming():
            raise ReadOnlyQueryError(f"Streams can't be queried: '{node.tableName()}'.")
    if kind == "UnresolvedTableValuedFunction" and node.name().last().lower() not in TABLE_FUNCTIONS:
        raise ReadOnlyQueryError(f"Forbidden table function '{node.name().last()}'.")


def _parse(spark: SparkSession, sql: str):
    if not sql or not sql.strip():
        raise ReadOnlyQueryError("Empty SQL is not allowed.")
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        if ";" in sql.strip().rstrip(";"):
            raise ReadOnlyQueryError("Multiple SQL statements are not allowed, or the statement is malformed.") from error
        raise ReadOnlyQueryError(f"Not a read-only query: {error}") from error


def check_read_only(spark: SparkSession, sql: str) -> None:
    """Refuse a statement that is not made of known reading parts, judged by the plan Spark's parser makes of it.

    This has to happen before ``spark.sql``, which runs commands at once. Names that
    are only known when the statement runs (``IDENTIFIER``, ``EXECUTE IMMEDIATE``)
    and programs of the operating system (``TRANSFORM``) are no known parts.
    """
    plan = _parse(spark, sql)
    for node in _nodes(plan):
        if _kind(node) not in PARSED_NODES and _kind(node) not in READ_COMMANDS:
            raise ReadOnlyQueryError(f"Forbidden SQL operation '{_kind(node)}'. Only read-only queries are allowed.")
        _refuse_relation(spark, node)
        for expression in _each(node.expressions()):
            _refuse_expression(expression)


def _check_analyzed(result: DataFrame) -> DataFrame:
    """``result`` if its analyzed plan is made of known reading parts as well; nothing has run yet."""
    for node in _nodes(result._jdf.queryExecution().analyzed()):
        if _kind(node) == "View":
            continue
        if _kind(node) not in ANALYZED_NODES:
            raise ReadOnlyQueryError(f"Forbidden SQL operation '{_kind(node)}'. Only read-only queries are allowed.")
        for expression in _each(node.expressions()):
            _refuse_expression(expression)
    return result


def run_query(spark: SparkSession, sql: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A read-only query, or one page of it. Order the query to get stable pages."""
    check_read_only(spark, sql)
    result = spark.sql(sql)
    if _kind(_parse(spark, sql)) not in READ_COMMANDS:
        _check_analyzed(result)
    if offset:
        result = result.offset(int(offset))
    return result if limit is None else result.limit(int(limit))


def query_sources(spark: SparkSession, sql: str) -> list[str]:
    """Tables and views that a query reads, without its own CTEs."""
    names = set()
    for node in _nodes(_parse(spark, sql)):
        if _kind(node) == "UnresolvedRelation":
            name = node.tableName()
            if spark.catalog.tableExists(name):
                names.add(name)
    return sorted(names)


@dataclass(frozen=True)
class CustomMetric:
    """A metric as an aggregate SQL expression over the columns of one table, without subqueries."""

    name: str
    label: str
    sql_expression: str
    table: str
    benchmark_good: float = 0.0
    benchmark_ok: float = 0.0
    unit: str = ""


def _metric_value(spark: SparkSession, text: str) -> Column:
    """The column of a metric's expression, which may reach nothing but its table."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except ParseException as error:
        raise ReadOnlyQueryError(f"Not an expression: {error}") from error
    _refuse_expression(tree)
    _refuse_subqueries(spark, tree)
    return F.expr(text)


def _refuse_subqueries(spark: SparkSession, tree) -> None:
    if spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance(tree):
        raise ReadOnlyQueryError("A metric's expression can't hold a subquery.")
    for part in _each(tree.children()):
        _refuse_subqueries(spark, part)


def custom_metric(table: DataFrame, metric: CustomMetric, higher_is_better: bool = True) -> DataFrame:
    """One row: the metric's value and its verdict against the benchmarks.

    Expressions that reach beyond the table (subqueries, reflection) are refused as in ``run_query``.
    """
    value = _metric_value(table.sparkSession, metric.sql_expression).cast("double").alias("value")
    return table.agg(value).select(
        F.lit(metric.name).alias("name"),
        F.lit(metric.label).alias("label"),
        "value",
        F.lit(metric.unit).alias("unit"),
        classify_metric(
            F.col("value"), F.lit(metric.benchmark_good), F.lit(metric.benchmark_ok), higher_is_better
        ).alias("verdict"),
    )


def benchmark_join(
    values: DataFrame, channel_col: str | None, value_col: str, higher_is_better: bool | None = None, metric: str = "cac"
) -> DataFrame:
    """Values with the threshold of ``metric`` (see ``METRICS``) and the verdict; null without one.

    The threshold of ``cac`` depends on the row's channel; the others hold for every row.
    """
    threshold, higher = metric_threshold(metric, None if channel_col is None else F.col(channel_col))
    higher_is_better = higher if higher_is_better is None else higher_is_better
    return (
        values.withColumn("t", threshold)
        .select(
            "*",
            F.col("t.benchmark").alias("benchmark"),
            F.col("t.good").alias("good"),
            F.col("t.ok").alias("ok"),
            F.when(
                F.col("t").isNotNull(),
                classify_metric(F.col(value_col), F.col("t.good"), F.col("t.ok"), higher_is_better),
            ).alias("verdict"),
        )
        .drop("t")
    )
