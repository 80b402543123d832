"""A gate for SQL that users send: read-only, known tables only, a cap on rows, masks and row filters beneath it."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from quern.operators.governance import masked, permitted

MOST_OFFSET = 1_000_000
#: Words that begin statements which write or change settings.
WRITES = ("insert", "update", "delete", "merge", "drop", "create", "alter", "truncate", "grant", "revoke", "set", "use", "cache", "refresh", "load", "analyze", "call", "add")

#: Functions that call code, tell about the cluster or its files, or stop a query on purpose.
CLOSED = ("java_method", "reflect", "try_reflect", "version", "current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "spark_partition_id", "raise_error", "assert_true", "sleep", "from_xml", "schema_of_xml")


class Refused(ValueError):
    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code = code


def bare(sql: str) -> str:
    """The statement without comments and with its literals emptied, in lower case."""
    sql = re.sub(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"", "''", sql, flags=re.S)
    return re.sub(r"/\*.*?\*/|--[^\n]*", " ", sql, flags=re.S).strip().rstrip(";").strip().lower()


def read_only(sql: str) -> str:
    """The statement if it is one query and nothing else."""
    text = bare(sql)
    if ";" in text:
        raise Refused("multiple_statements", "one statement is allowed")
    if not re.match(r"(select|with|values)\b", text) or re.search(rf"(^|\)\s*)\b({'|'.join(WRITES)})\b", text):
        raise Refused("not_read_only", text[:40])
    return sql.strip().rstrip(";")


@lru_cache(maxsize=1)
def functions(version: str, listing: tuple[str, ...]) -> frozenset[str]:
    return frozenset(name for name in listing if name not in CLOSED and not name.startswith("input_file"))


def known_functions(spark: SparkSession) -> frozenset[str]:
    """The functions that a user's query may call: Spark's own, without those that reach out of the data. Registered ones are not among them."""
    listing = tuple(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
    return functions(spark.version, listing)


def parsed(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("not_parsed", str(e).splitlines()[0][:80]) from None


def named(spark: SparkSession, sql: str) -> tuple[set[str], set[str]]:
    """The tables that a query reads and the functions that it calls, as Spark's own parser sees them.

    Names are resolved scope by scope: a name that a WITH defines stands for that query only below it, and not inside its own
    definition unless that is recursive. Qualified names and paths come with their dots, so they are no known table. Statements
    that are no queries, table functions, scripts and names computed at run time are refused.
    """
    tables: set[str] = set()
    calls: set[str] = set()
    holds_plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    each = lambda items: [items.apply(i) for i in range(items.length())]
    kind = lambda node: node.getClass().getSimpleName()
    parts = lambda items: ".".join(each(items)).lower()

    def expression(node, scope: frozenset[str]) -> None:
        name = kind(node)
        if name == "UnresolvedFunction":
            calls.add(parts(node.nameParts()))
        if "Identifier" in name and "Unresolved" in name:
            raise Refused("computed_name", "names must be written out")
        if holds_plan.isInstance(node):
            plan(node.plan(), scope)
        for child in each(node.children()):
            expression(child, scope)

    def plan(node, scope: frozenset[str]) -> None:
        name = kind(node)
        if name.endswith(("Command", "Statement")) or "InsertInto" in name or "ScriptTransformation" in name or "Compound" in name:
            raise Refused("not_read_only", name)
        if "TableValuedFunction" in name:
            raise Refused("table_function", "functions in place of tables are not allowed")
        if "Identifier" in name:
            raise Refused("computed_name", "names must be written out")
        if name == "UnresolvedRelation":
            found = parts(node.multipartIdentifier())
            if found not in scope:
                tables.add(found)
        if name == "UnresolvedWith":
            for item in each(node.cteRelations()):
                own = item._1().lower()
                plan(item._2(), scope | {own} if node.allowRecursion() else scope)
                scope = scope | {own}
        for item in each(node.expressions()):
            expression(item, scope)
        for child in each(node.children()):
            plan(child, scope)

    plan(parsed(spark, sql), frozenset())
    return tables, calls


def relations(spark: SparkSession, sql: str) -> set[str]:
    """The tables that a query reads."""
    return named(spark, sql)[0]


class Workspace:
    """Tables under policies, and the queries that users may send over them.

    Masks and row filters are part of the views that queries see, so no form of query gets around them; Catalyst pushes users'
    own filters beneath them where that is safe. A workspace has a session of its own: views of other workspaces, or of the
    program around it, are not there, and other threads cannot put other policies under its names.
    """

    def __init__(self, spark: SparkSession, most_rows: int = 1000) -> None:
        self.spark, self.most_rows, self.tables = spark, most_rows, {}
        self.session = spark.newSession()

    def register(self, name: str, rows: DataFrame, masks: dict[str, str] | None = None, filters: list[str] | None = None) -> None:
        seen = masked(permitted(rows, filters) if filters is not None else rows, masks or {})
        passing = f"quern_{uuid4().hex}"  # the way from one session to another
        seen.createGlobalTempView(passing)
        try:
            self.session.table(f"global_temp.{passing}").createOrReplaceTempView(name.lower())
        finally:
            self.spark.catalog.dropGlobalTempView(passing)
        self.tables[name.lower()] = seen

    def query(self, sql: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        """The rows of a query, capped; unknown tables and functions are refused before anything runs."""
        statement = read_only(sql)
        names, calls = named(self.session, statement)
        if unknown := names - set(self.tables):
            raise Refused("unknown_table", ", ".join(sorted(unknown)))
        if unknown := calls - known_functions(self.session):
            raise Refused("unknown_function", ", ".join(sorted(unknown)))
        if not 0 <= offset <= MOST_OFFSET:
            raise Refused("bad_offset", str(offset))
        rows = self.session.sql(statement)
        return (rows.offset(offset) if offset else rows).limit(min(limit if limit is not None else self.most_rows, self.most_rows))


def cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(f"offset:{offset}".encode()).decode()


def position(token: str) -> int:
    """The offset that a cursor tells; others than those that cursor() gives are refused."""
    try:
        found = re.fullmatch(r"offset:(\d+)", base64.urlsafe_b64decode(token.encode()).decode())
    except (ValueError, UnicodeDecodeError):
        found = None
    if not found or int(found[1]) > MOST_OFFSET:
        raise Refused("bad_cursor", token[:40])
    return int(found[1])
