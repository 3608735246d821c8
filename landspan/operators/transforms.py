"""SQL scripts and the statement forms Spark has no statement for."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.operators.script_text import BODY, CREATE, IDENT, LITERAL, NAME, TEMP
from landspan.operators.tables import replace_table
from landspan.workspace import materialize, pinned

_QUOTED = r'"[^"]*"|`[^`]*`'
_COMMENT = re.compile(rf"({LITERAL}|{_QUOTED})|--[^\n]*|(?s:/\*.*?\*/)")
_STATEMENT = re.compile(rf"(?:{LITERAL}|{_QUOTED}|{BODY}|[^;'$\"`]|[$'\"`])+")
_TEMP_TABLE = re.compile(rf"(?is)^{CREATE}{TEMP}table\s+(?:if\s+not\s+exists\s+)?({NAME})\s+as\s+(.*)$")
_BLOCK = re.compile(r"(?is)^\s*begin\b(?!\s*(?:;|transaction)).*\bend\s*;?\s*$")


_ANY_NAME = rf"(?:{IDENT}|`[^`]+`)"
_UPDATE = re.compile(
    rf"(?is)^update\s+(?:only\s+)?({_ANY_NAME}(?:\s*\.\s*{_ANY_NAME})*+)"
    rf"(?:\s+(?:as\s+)?(?!set\b)({_ANY_NAME}))?\s+(?=set\b)")
_TOKEN = re.compile(rf"(?s){LITERAL}|{_QUOTED}|\w+|.")


def _outside(text: str) -> Iterator[re.Match]:
    """Tokens that stand in no quotes and no brackets."""
    depth = 0
    for token in _TOKEN.finditer(text):
        depth -= token.group() in (")", "]")
        if depth == 0:
            yield token
        depth += token.group() in ("(", "[")


def parse_update(statement: str) -> tuple[str, str | None, str, str | None, str | None] | None:
    """(table, alias, assignments, source, condition) of an UPDATE, None for other statements."""
    head = _UPDATE.match(statement)
    if head is None:
        return None
    text = statement[head.end():]
    cuts: dict[str, re.Match] = {}
    before = ""
    for token in _outside(text):
        word = token.group().lower()
        # IS DISTINCT FROM is no clause.
        if word in ("set", "from", "where") and word not in cuts and before != "distinct" and "where" not in cuts:
            cuts[word] = token
        before = word if word.strip() else before
    order = sorted(cuts.items(), key=lambda c: c[1].start())
    ends = [cut.start() for _, cut in order[1:]] + [len(text)]
    clauses = {word: text[cut.end():end].strip() for (word, cut), end in zip(order, ends)}
    return head.group(1), head.group(2), clauses["set"], clauses.get("from"), clauses.get("where")


def _split(text: str, mark: str, most: int = 0) -> list[str]:
    """Pieces between marks outside quotes and brackets."""
    at = [t.start() for t in _outside(text) if t.group() == mark][:most or None]
    return [text[a:b].strip() for a, b in zip([0, *[x + 1 for x in at]], [*at, len(text)])]


def _bare(name: str) -> str:
    return name.strip().strip('`"')


def _targets(assignments: str, columns: list[str], qualifiers: set[str], exact: bool) -> dict[str, str]:
    """Column of the table to new value; names as Spark resolves them, unknown ones raise."""
    same = (lambda x: x) if exact else str.lower
    known = {same(c): c for c in columns}
    out = {}
    for pair in _split(assignments, ","):
        name, *value = _split(pair, "=", 1)
        *owner, column = [_bare(part) for part in _split(name, ".")]
        if not value or same(column) not in known or (
                owner and same(owner[-1]) not in map(same, qualifiers)):
            raise ValueError(f"UPDATE sets {name!r}, which is no column of the table")
        out[known[same(column)]] = value[0]
    return out


def split_statements(sql: str) -> list[str]:
    """Statements of one script; comments are dropped, quoted text stays whole."""
    plain = _COMMENT.sub(lambda m: m.group(1) or " ", sql)
    pieces = (m.group(0).strip() for m in _STATEMENT.finditer(plain))
    return [piece for piece in pieces if piece]


_SPOTS = "flatten(flatten(({g}).parts))"
_POINTS = (f"CASE WHEN ({{g}}) IS NULL THEN NULL WHEN ({{g}}).kind IN ('Point', 'MultiPoint') THEN {_SPOTS}"
           " ELSE raise_error('a union of points holds a ' || ({g}).kind) END")
# Aggregates over geometries, as built-in ones with partial results. A union holds points only.
AGGREGATES = {
    "st_union": (
        "CASE WHEN count({g}) = 0 THEN NULL WHEN min(({g}).srid) <> max(({g}).srid)"
        " THEN raise_error('a union holds several SRIDs') ELSE named_struct('srid', min(({g}).srid), 'kind',"
        f" 'MultiPoint', 'parts', transform(array_sort(array_distinct(flatten(collect_set({_POINTS})))),"
        " v -> array(array(v)))) END"),
    "st_extent": "named_struct(" + ", ".join(
        f"'{axis}{end}', {end}(array_{end}(transform({_SPOTS}, v -> v.{axis})))"
        for end in ("min", "max") for axis in "xy") + ")",
}


def expand_aggregates(statement: str) -> str:
    """Write calls of ``AGGREGATES`` out; names in quotes and comments stay."""
    tokens = re.compile(r"""(?is)'(?:[^'\\]|\\.|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[()]|\b(st_union|st_extent)\s*\(""")
    at, found = 0, None
    while True:
        depth, opened = 0, None
        for token in tokens.finditer(statement, at):
            if token.group(1) and opened is None:
                opened, depth = token, 1
            elif token.group() == "(" or token.group(1):
                depth += opened is not None
            elif token.group() == ")" and opened is not None:
                depth -= 1
                if depth == 0:
                    found = opened.start(), opened.group(1).lower(), statement[opened.end():token.start()], token.end()
                    break
        else:
            return statement
        begin, name, argument, end = found
        # The SRID of extents plays no part.
        body = AGGREGATES[name].replace("{g}", expand_aggregates(argument).strip())
        statement, at = statement[:begin] + body + statement[end:], begin + len(body)


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """Temporary table: a temp view over a written copy, fixed at this moment."""
    copy = materialize(df, "temp-table")
    copy.createOrReplaceTempView(name)
    return copy


def run_script(spark: SparkSession, sql: str) -> DataFrame | None:
    """Run a Spark SQL script statement by statement; the first error stops it.

    ``BEGIN ... END`` blocks run natively.  ``CREATE TEMP TABLE ... AS`` becomes a
    snapshot.  ``begin`` and ``commit`` have no effect, since Spark publishes each
    statement on its own; ``rollback`` raises.  ``UPDATE`` rewrites its table, see
    ``update_table``.  ``st_union`` and ``st_extent`` aggregate geometries.  Returns the result of the last statement.
    """
    if _BLOCK.match(sql):
        return spark.sql(expand_aggregates(sql))
    result = None
    for statement in map(expand_aggregates, split_statements(sql)):
        temp = _TEMP_TABLE.match(statement)
        if temp:
            result = snapshot(spark.sql(temp.group(2)), temp.group(1).strip('"'))
        elif re.fullmatch(r"(?is)(begin|start)(\s+transaction)?|commit", statement):
            continue
        elif re.match(r"(?i)rollback\b", statement):
            raise NotImplementedError("a statement that was published cannot be rolled back")
        elif update := parse_update(statement):
            result = update_table(spark, *update)
        else:
            result = spark.sql(statement)
    return result


def _agreed(low: str, high: str) -> Column:
    """The one value of a group; several different ones are an error."""
    clash = F.raise_error(F.lit("several different source rows match one row"))
    return F.when(F.col(low) == F.col(high), F.col(low)).otherwise(clash)


def update_table(
    spark: SparkSession, table: str, alias: str | None, assignments: str,
    source: str | None = None, condition: str | None = None,
) -> DataFrame:
    """``UPDATE table [alias] SET assignments [FROM source] [WHERE condition]``.

    The clauses are Spark SQL text.  The new version of the table replaces the old one;
    source rows that disagree about one target row are an error.
    """
    parts = [_bare(part) for part in _split(table, ".")]
    table = ".".join(parts)
    alias = _bare(alias or parts[-1])
    old = spark.table(".".join(f"`{part}`" for part in parts))
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    assign = _targets(assignments, old.columns, {alias}, exact)
    rows = pinned(old.withColumn("__row", F.monotonically_increasing_id()))
    view = f"update_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    new = ", ".join(f"{value} AS `{column}`" for column, value in assign.items())
    hits = spark.sql(
        f"SELECT `{alias}`.__row, struct({new}) AS new FROM {view} AS `{alias}`"
        + (f", {source}" if source else "") + (f" WHERE {condition}" if condition else "")
    )
    one = hits.groupBy("__row").agg(F.min("new").alias("lo"), F.max("new").alias("hi")).select(
        "__row", _agreed("lo", "hi").alias("new")
    )
    columns = [
        F.when(F.col("new").isNotNull(), F.col("new")[f.name].cast(f.dataType))
        .otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in assign else F.col(f"`{f.name}`")
        for f in old.schema.fields
    ]
    return replace_table(rows.join(one, "__row", "left").select(columns), table)


def update_from(
    target: DataFrame, source: DataFrame, on: dict[str, str], assign: dict[str, str]
) -> DataFrame:
    """Rows of ``target`` after ``UPDATE t SET ... FROM s WHERE t.a = s.b``.

    ``on`` maps target to source columns; ``assign`` maps target columns to SQL over the
    aliases ``t`` and ``s``.  Source rows are first reduced to one per key, with partial
    aggregation; rows of one key that disagree are an error, since the outcome would
    depend on their order.
    """
    source_keys = list(on.values())
    others = [c for c in source.columns if c not in source_keys]
    values = F.struct(F.lit(True).alias("__hit"), *[F.col(f"`{c}`") for c in others])
    one = (
        source.where(reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in source_keys]))
        .groupBy(*[F.col(f"`{k}`") for k in source_keys])
        .agg(F.min(values).alias("__lo"), F.max(values).alias("__hi"))
    )
    one = one.withColumn("__row", _agreed("__lo", "__hi")).select(*source_keys, "__row.*").alias("s")
    match = [F.col(f"t.`{a}`") == F.col(f"s.`{b}`") for a, b in on.items()]
    columns = [
        F.when(F.col("s.__hit"), F.expr(assign[c]).cast(target.schema[c].dataType))
        .otherwise(F.col(f"t.`{c}`")).alias(c) if c in assign else F.col(f"t.`{c}`")
        for c in target.columns
    ]
    return target.alias("t").join(one, match, "left").select(columns)
