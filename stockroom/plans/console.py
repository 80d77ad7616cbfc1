"""Ad-hoc SQL console (S8, S9): read-only Spark SQL over the registered views.

The source forwards any text to the database and only refuses statements
that *start* with DROP DATABASE / DROP TABLE.  Here an allow-list on the parsed
plan decides, before anything is analysed or run: every node of the statement, at
any depth and in any field, must be a plan or expression class known to read only;
functions must be Spark's own, of the groups that compute from their arguments;
relations must be views or tables of the catalog (no paths, no table options, no
names computed by IDENTIFIER).  What is not known is refused, so a kind of
statement that a later Spark adds is refused too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed console texts and keywords.
EMPTY_QUERY = "Empty query"
DROP_DISABLED = "DROP DATABASE and DROP TABLE are disabled in the query console."
READ_ONLY = "Only read-only statements (SELECT, WITH, SHOW, DESCRIBE, EXPLAIN, VALUES, TABLE) are allowed."
READ_KEYWORDS = ("SELECT", "WITH", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "VALUES", "TABLE", "FROM")

FUNCTION_DISABLED = "This function is disabled in the query console."
NOT_ALLOWED = "This form of statement is not allowed in the query console."
RELATION_DISABLED = "Only tables and views of the catalog can be read in the query console."

# Fixed lists: what may stand in a statement.  Commands are allowed as the statement
# itself (or under EXPLAIN), with what names their object.
COMMANDS = set("""ShowTables ShowViews ShowColumns ShowNamespacesCommand ShowFunctions ShowCreateTable DescribeRelation
    DescribeColumn DescribeFunction DescribeNamespace DescribeQueryCommand ExplainCommand""".split())
PLANS = set("""Aggregate CurrentNamespace Distinct Except Filter GlobalLimit Intersect Join LateralJoin LocalLimit
    LocalRelation Offset OneRowRelation PipeOperator Pivot Project RepartitionByExpression Sample Sort SubqueryAlias Union
    Unpivot UnresolvedFunctionName UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedNamespace
    UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableOrView UnresolvedTableValuedFunction
    UnresolvedTVFAliases UnresolvedWith WithWindowDefinition Generate UnionLoop""".split())
EXPRESSIONS = set("""Add Alias And AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce
    Collate Concat CreateNamedStruct Cube CurrentRow Divide EqualNullSafe EqualTo Exists Explode GreaterThan GreaterThanOrEqual
    GroupingSets ILike If In InSubquery IntegralDivide IsNotNull IsNull IsUnknown IsNotUnknown LambdaFunction LateralSubquery
    LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Lower MultiAlias Multiply NamedParameter Not NotLikeAll
    NotLikeAny Or Overlay PipeExpression PosExplode PosParameter RLike Remainder Rollup ScalarSubquery SortOrder
    SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract TimestampAdd TimestampDiff
    UnaryMinus UnaryPositive UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedCollation
    UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal
    UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedWindowExpression UnspecifiedFrame WindowExpression
    WindowSpecDefinition""".split())
FUNCTION_GROUPS = set("""predicate_funcs math_funcs bitwise_funcs datetime_funcs lambda_funcs agg_funcs array_funcs string_funcs
    conditional_funcs conversion_funcs collection_funcs generator_funcs hash_funcs window_funcs csv_funcs json_funcs
    variant_funcs map_funcs struct_funcs url_funcs""".split())
# Of the mixed group, which also holds calls of JVM methods.
OTHER_FUNCTIONS = set("current_catalog current_database current_schema current_user session_user typeof user uuid version".split())
TABLE_FUNCTIONS = {"range"}

_SPARK = "org.apache.spark.sql."
_COMMENTS = re.compile(r"(--[^\n]*\n?)|(/\*.*?\*/)", re.S)


class ConsoleError(ValueError):
    pass


@dataclass
class ConsoleResult:
    kind: str
    df: DataFrame


def _first_keyword(sql: str) -> str:
    body = _COMMENTS.sub(" ", sql).strip().lstrip("(").strip()
    m = re.match(r"[A-Za-z]+", body)
    return m.group(0).upper() if m else ""


def check_sql(sql: str | None) -> str:
    """Return the statement to run (trailing ';' removed) or raise ConsoleError."""
    if sql is None or not sql.strip():
        raise ConsoleError(EMPTY_QUERY)
    upper = sql.strip().upper()
    if upper.startswith("DROP DATABASE") or upper.startswith("DROP TABLE"):
        raise ConsoleError(DROP_DISABLED)
    if _first_keyword(sql) not in READ_KEYWORDS:
        raise ConsoleError(READ_ONLY)
    body = sql.strip()
    while body.endswith(";"):
        body = body[:-1].rstrip()
    return body  # Spark's parser itself refuses a second statement


class _Walk:
    """The nodes of a parsed statement, whatever field they stand in."""

    def __init__(self, spark: SparkSession):
        kind = spark._jvm.java.lang.Class.forName
        self.node = kind(_SPARK + "catalyst.trees.TreeNode")
        self.plan = kind(_SPARK + "catalyst.plans.logical.LogicalPlan")
        self.expression = kind(_SPARK + "catalyst.expressions.Expression")
        self.many, self.fields = kind("scala.collection.Iterable"), kind("scala.Product")

    def inside(self, value) -> list:
        """The nodes that a value holds, or the value itself if it is one."""
        if not hasattr(value, "getClass"):
            return []
        if self.node.isInstance(value):
            return [value]
        if self.many.isInstance(value):
            it = value.iterator()
        elif self.fields.isInstance(value):
            it = value.productIterator()
        else:
            return []
        out = []
        while it.hasNext():
            out += self.inside(it.next())
        return out

    def below(self, node) -> list:
        out, it = [], node.productIterator()
        while it.hasNext():
            out += self.inside(it.next())
        return out


def _kind(node) -> str:
    """The class of a node: its last name (objects end in $, local classes have theirs after it)."""
    name = node.getClass().getName()
    if not name.startswith(_SPARK):
        raise ConsoleError(NOT_ALLOWED)
    return name.rpartition(".")[2].split("$")[0]


def _names(parts) -> list[str]:
    return [parts.apply(i) for i in range(parts.size())]


def _check_relation(spark: SparkSession, parts: list[str]) -> None:
    """One name is a view or table by itself; a longer one must be in the catalog, for it
    may else be a data source and a path."""
    if len(parts) > 1 and not spark.catalog.tableExists(".".join("`" + p.replace("`", "``") + "`" for p in parts)):
        raise ConsoleError(RELATION_DISABLED)


def _check_function(spark: SparkSession, parts: list[str]) -> None:
    name = parts[-1].lower()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    catalog = spark._jsparkSession.sessionState().catalog()
    if len(parts) > 1 or not catalog.functionExists(identifier):
        raise ConsoleError(FUNCTION_DISABLED)
    info = catalog.lookupFunctionInfo(identifier)      # a session's own function hides Spark's
    if info.getSource() != "built-in" or not (info.getGroup() in FUNCTION_GROUPS or name in OTHER_FUNCTIONS):
        raise ConsoleError(FUNCTION_DISABLED)


def check_plan(spark: SparkSession, body: str) -> None:
    """Refuse a statement unless all of it is known to read only."""
    walk = _Walk(spark)
    root = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    todo = [(root, True)]
    while todo:
        node, top = todo.pop()
        name = _kind(node)
        if walk.plan.isInstance(node):
            if name not in PLANS and not (top and name in COMMANDS):
                raise ConsoleError(READ_ONLY)
            if name in ("UnresolvedRelation", "UnresolvedTableOrView"):
                _check_relation(spark, _names(node.multipartIdentifier()))
                if name == "UnresolvedRelation" and not node.options().isEmpty():
                    raise ConsoleError(RELATION_DISABLED)
            elif name == "UnresolvedTableValuedFunction":
                parts = _names(node.name())
                if [p.lower() for p in parts] not in [[f] for f in TABLE_FUNCTIONS]:
                    _check_function(spark, parts)
        elif walk.expression.isInstance(node):
            if name not in EXPRESSIONS:
                raise ConsoleError(NOT_ALLOWED)
            if name == "UnresolvedFunction":
                _check_function(spark, _names(node.nameParts()))
        else:
            raise ConsoleError(NOT_ALLOWED)
        todo += [(x, top and name == "ExplainCommand") for x in walk.below(node)]


def adhoc_sql(spark: SparkSession, sql: str, args: dict | None = None) -> ConsoleResult:
    """Run one read-only statement; ``args`` binds named parameters."""
    body = check_sql(sql)
    check_plan(spark, body)
    return ConsoleResult("select", spark.sql(body, args=args) if args else spark.sql(body))


def result_meta(df: DataFrame) -> DataFrame:
    """Row count, column count and column names of a result (one row)."""
    cols = df.columns
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(cols)).alias("column_count"),
        F.lit(",".join(cols)).alias("columns"))
