"""Which statements may run: queries over the given tables, with functions that only compute.

A statement is parsed (nothing is looked up yet, no file is opened) and its plan is walked. Allowed are
the plan nodes of queries, relations with a plain name, and functions of the computing groups of the built-in
registry: reflection, file and session information, table functions, paths in place of
tables, scripts and commands are errors. After analysis every table must lie below a given view (or, in
the current session, be a table of its catalog).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Function groups of the built-in registry whose members only compute. Fixed values.
GROUPS = (
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs",
    "struct_funcs", "window_funcs",
)
# Harmless members of other groups.
FUNCTIONS = ("typeof", "equal_null")
# Plan nodes that the parser makes of queries.
NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "LateralJoin", "Union", "Intersect", "Except",
    "Distinct", "SubqueryAlias", "OneRowRelation", "OneRowRelation$", "WithWindowDefinition", "Window", "Generate", "Pivot", "Unpivot", "Sample",
    "UnresolvedWith", "UnresolvedRelation", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "UnresolvedOrderBy",
    "UnresolvedHint", "LocalRelation",
}
UNRESOLVED = {
    "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedFunction", "UnresolvedStar", "UnresolvedOrdinal", "UnresolvedExtractValue",
    "UnresolvedRegex", "UnresolvedGenerator", "UnresolvedWindowExpression", "UnresolvedNamedLambdaVariable", "UnresolvedDeserializer",
}
_SOURCES = ("LogicalRelation", "HiveTableRelation", "DataSourceV2Relation", "DataSourceV2ScanRelation", "StreamingRelation", "StreamingRelationV2", "Range", "LogicalRDD")


class NotAllowed(ValueError):
    """The statement asks for something other than a query over the given tables."""


def _nodes(value) -> Iterator[dict]:
    """All nodes of a plan in JSON, those inside expressions and subqueries included."""
    if isinstance(value, dict):
        if "class" in value:
            yield value
        for v in value.values():
            yield from _nodes(v)
    elif isinstance(value, list):
        for v in value:
            yield from _nodes(v)


def _names(node: dict, field: str) -> list[str]:
    return str(node.get(field, "")).strip("[]").split(", ")


def _check_function(registry, spark: SparkSession, parts: list[str]) -> None:
    name = parts[-1].lower()
    if len(parts) == 1 and name in FUNCTIONS:
        return
    found = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)) if len(parts) == 1 else None
    if found is None or not found.isDefined() or found.get().getGroup() not in GROUPS:
        raise NotAllowed(f"function {'.'.join(parts)} is not allowed")


def checked(session: SparkSession, text: str, views: set[str] | None = None) -> DataFrame:
    """The statement as a DataFrame, if it is allowed. ``views`` are the given tables (``None``: those of the session)."""
    state = session._jsparkSession.sessionState()
    registry = state.functionRegistry()
    parsed = json.loads(state.sqlParser().parsePlan(f"SELECT * FROM (\n{text}\n)").toJSON())
    for node in _nodes(parsed):
        package, _, name = node["class"].rpartition(".")
        if name == "UnresolvedFunction":
            _check_function(registry, session, _names(node, "nameParts"))
        elif name == "UnresolvedGenerator":
            called = node.get("name") or {}
            _check_function(registry, session, [called[k] for k in ("catalog", "database", "funcName") if called.get(k)])
        elif name == "UnresolvedRelation":
            parts = _names(node, "multipartIdentifier")
            if len(parts) > 1 and (views is not None or not session.catalog.tableExists(".".join(f"`{p}`" for p in parts))):
                raise NotAllowed(f"{'.'.join(parts)} is not a given table")
        elif ".plans.logical" in package or ".execution" in package or package.endswith(".analysis") and name not in UNRESOLVED:
            if name not in NODES:
                raise NotAllowed(f"{name} is not allowed")
    result = session.sql(text)
    _check_sources(json.loads(result._jdf.queryExecution().analyzed().toJSON()), views)
    return result


def _check_sources(analyzed: list, views: set[str] | None) -> None:
    """Tables outside of views are errors; what a given view itself reads is not looked at."""
    def subtree(nodes: list, at: int, given: bool) -> int:
        node = nodes[at]
        name = node["class"].rpartition(".")[2]
        given = given or name == "View"
        if not given and name in _SOURCES and (views is not None or node.get("catalogTable") is None and name != "HiveTableRelation"):
            raise NotAllowed("only given tables can be read")
        if not given:
            for value in node.values():  # plans inside expressions
                inner(value)
        to = at + 1
        for _ in range(node.get("num-children", 0)):
            to = subtree(nodes, to, given)
        return to

    def inner(value) -> None:
        if isinstance(value, list) and value and isinstance(value[0], dict) and "class" in value[0]:
            subtree(value, 0, False)
        elif isinstance(value, list):
            for v in value:
                inner(v)

    subtree(analyzed, 0, False)
