"""Object events from a table of SQL texts ``scripts(script_id, sql)``.

Shallow patterns for a known list of statement forms, applied as column expressions to
a whole query log; this is no grammar.  Other statements yield kind ``unhandled``.
Known limits: nested parentheses inside ``extract(... from ...)``-like calls, and string
literals with a backslash escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENT = r'(?:"[^"]+"|[A-Za-z_][A-Za-z0-9_$]*+)'
NAME = rf"{IDENT}(?:\s*\.\s*{IDENT})*+"
LITERAL = r"'[^']*+(?:''[^']*+)*+'"
BODY = r"(?s:\$(\w*)\$.*?\$\1\$)"
PREFIX = r"(?is)^"
CREATE = r"create\s+(?:or\s+replace\s+)?"
TEMP = r"(?:local\s+|global\s+)?temp(?:orary)?\s+"
RELATION = r"(?:unlogged\s+|materialized\s+|recursive\s+)*(?:table|view)\s+(?:if\s+not\s+exists\s+)?"

# Statement kind, pattern up to the target, whether a target follows.  First match wins.
FORMS = [
    ("begin", r"(?:begin|start\s+transaction)\b", False),
    ("commit", r"(?:commit|end)\b", False),
    ("rollback", r"rollback\b", False),
    ("create_temp", rf"{CREATE}{TEMP}{RELATION}", True),
    ("create_table", r"create\s+(?:unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?", True),
    ("create_view", rf"{CREATE}{RELATION}", True),
    ("create_function", rf"{CREATE}function\s+", True),
    ("create_index", r"create\s+(?:unique\s+)?index\b", False),
    ("insert", r"(?:with\b.*?\))?\s*insert\s+into\s+", True),
    ("update", r"update\s+(?:only\s+)?", True),
    ("alter", r"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?", True),
    ("analyze", r"analyze\s+(?:verbose\s+)?", True),
    ("drop_function", r"drop\s+function\s+(?:if\s+exists\s+)?", True),
    ("drop", r"drop\s+(?:materialized\s+)?(?:table|view|index|sequence)\s+(?:if\s+exists\s+)?", True),
    ("set", r"set\b", False),
]

# Words that may stand before "(" or after FROM/JOIN without naming anything.
KEYWORDS = """
    all and any array as between by case check conflict constraint cross cube default
    distinct do else end except exclude exists fetch filter for foreign from full group
    grouping having if in inner intersect interval into is join key lateral left like
    limit not nothing offset on only or order outer over partition primary references
    returning right rollup row select set sets some table tablesample then union unique
    update using values when where window with within zone
""".split()
# Column types that may carry a length or precision.
TYPES = """
    bit char character decimal geography geometry numeric time timestamp timestamptz
    varbit varchar varying
""".split()
# Common built-in functions of the scripts' database that Spark lacks.
DATABASE_BUILTINS = """
    age array_to_string clock_timestamp currval generate_series gen_random_uuid
    json_agg json_build_object jsonb_agg jsonb_build_object nextval row_to_json setval
    string_agg string_to_array to_json to_jsonb unnest
""".split()


def _clean(sql: Column) -> Column:
    """Drop comments, the content of string literals, and parameter numbers."""
    plain = F.regexp_replace(sql, rf"({LITERAL})|--[^\n]*+|(?s:/\*.*?\*/)", "$1 ")
    return F.regexp_replace(F.regexp_replace(plain, LITERAL, "''"), r"\$\d+", "?")


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(name, r'^"|"$', "")


def _object(full: Column) -> tuple[Column, Column]:
    """(schema, name) from the last two parts of a dotted name."""
    tidy = F.regexp_replace(full, r"\s*\.\s*", ".")
    name = F.regexp_extract(tidy, rf"({IDENT})$", 1)
    schema = F.regexp_extract(tidy, rf"({IDENT})\.{IDENT}$", 1)
    return _unquoted(schema), _unquoted(name)


def statements(scripts: DataFrame) -> DataFrame:
    """One row per statement: ``(script_id, stmt, kind, target, rest, body, columns)``.

    ``rest`` is the text after the target, ``body`` the dollar-quoted function body.
    """
    pieces = F.regexp_extract_all(
        _clean(F.col("sql")), F.lit(rf"((?:[^;$]++|(?s:\$(\w*)\$.*?\$\2\$)|\$)++)"), F.lit(1)
    )
    split = (
        scripts.select("script_id", F.posexplode(pieces).alias("stmt", "text"))
        .select("script_id", F.col("stmt").cast("long").alias("stmt"),
                F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
        .where("text <> ''")
    )
    kind, head = F.lit(None), F.lit("")
    for name, pattern, has_target in reversed(FORMS):
        full = rf"{PREFIX}{pattern}" + (rf"({NAME})" if has_target else "()")
        hit = F.col("text").rlike(full)
        kind = F.when(hit, name).otherwise(kind)
        head = F.when(hit, F.regexp_extract("text", full, 0)).otherwise(head)
    named = split.withColumns({"kind": F.coalesce(kind, F.lit("unhandled")), "head": head})
    rest = F.substr("text", F.length("head") + 1)
    has_name = F.col("kind").isin([name for name, _, target in FORMS if target])
    return named.select(
        "script_id", "stmt", "kind",
        F.when(has_name, F.regexp_extract("head", rf"(?is)({NAME})$", 1)).alias("target"),
        F.concat(
            # Common table expressions may come before INSERT.
            F.when(F.col("kind") == "insert", F.regexp_extract("head", r"(?is)^(.*?)\binsert\s", 1))
            .otherwise(""),
            F.when(F.col("kind") == "insert", F.regexp_replace(rest, r"^\s*\([^()]*\)", " "))
            .when(F.col("kind") == "create_function", "").otherwise(rest),
        ).alias("rest"),
        F.when(F.col("kind") == "create_function", F.nullif(
            F.regexp_extract(rest, r"(?s)\$(\w*)\$(.*?)\$\1\$", 2), F.lit(""))).alias("body"),
        rest.rlike(r"^\s*\(\s*(?!(?i:select|with|values)\b)[^()]*\)").alias("columns"),
    )


def _scanned(stmts: DataFrame) -> DataFrame:
    """Text to scan for references: the body of a function, else the rest; noise removed."""
    text = F.coalesce("body", "rest")
    for pattern, keep in (
        (r"(?i)\b(?:extract|substring|trim|overlay|position)\s*\([^()]*\)", " "),
        (r"(?i)\bis\s+(?:not\s+)?distinct\s+from\b", " = "),
    ):
        text = F.regexp_replace(text, pattern, keep)
    used = stmts.where(
        F.col("kind").isin("create_temp", "create_table", "create_view", "create_function",
                           "insert", "update")
    )
    return used.withColumn("scan", text)


# Words after which a FROM list is over, at the depth of its brackets.
LIST_ENDS = """
    where group having order limit union intersect except window returning set values on
    using fetch offset for select
""".split()


def _listed_names(text: Column) -> Column:
    """Names in FROM lists, after JOIN, REFERENCES, LIKE and TABLE.

    The text is cut to words, brackets and commas. A fold over them keeps one letter for each
    open bracket: ``f`` while a relation may come next, ``a`` after one (a comma brings the next),
    ``j`` the same within the condition of a join, ``r`` before the one name of a reference, ``x``
    elsewhere.
    """
    words = F.regexp_extract_all(text, F.lit(rf"({NAME}|[(),]|\S)"), F.lit(1))
    start = F.struct(F.lit("x").alias("open"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, word: Column) -> Column:
        low = F.lower(word)
        at, rest = F.right(state["open"], F.lit(1)), state["open"].substr(
            F.lit(1), F.length(state["open"]) - 1)
        named = at.isin("f", "r") & word.rlike(rf"^{NAME}$") & ~low.isin(KEYWORDS)
        letter = (
            F.when(low.isin("from", "join", "table"), "f")
            .when((low == "references") | ((low == "like") & (state["before"] == "(")), "r")
            .when(at == "r", "x")
            .when((at.isin("f", "a", "j")) & low.isin("on", "using"), "j")
            .when(low.isin(LIST_ENDS), "x")
            .when(low.isin("only", "lateral"), at)
            .when((word == ",") & at.isin("a", "j", "f"), "f")
            .when(at == "f", "a").otherwise(at)
        )
        is_open = word == "("
        return F.struct(
            # A bracket after a place for a relation holds a subquery or relations; others don't.
            F.when(is_open, F.concat(rest, F.when(at == "f", "a").otherwise(at),
                                     F.when(at == "f", "f").otherwise("x")))
            .when(word == ")", F.when(F.length(rest) > 0, rest).otherwise("x"))
            .otherwise(F.concat(rest, letter)).alias("open"),
            F.when(named, F.concat(state["found"], F.array(word)))
            # What turns out to be a call is no relation.
            .when(is_open & (at == "a") & state["called"], F.slice(
                state["found"], F.lit(1), F.greatest(F.size(state["found"]) - 1, F.lit(0))))
            .otherwise(state["found"]).alias("found"),
            (named & (at == "f")).alias("called"), word.alias("before"))

    begin = start.withField("called", F.lit(False)).withField("before", F.lit(""))
    return F.aggregate(words, begin, step)["found"]


def relation_references(stmts: DataFrame) -> DataFrame:
    """Relations a statement reads, minus its own target and its CTE names."""
    scanned = _scanned(stmts)
    names = _listed_names(F.col("scan"))
    ctes = F.transform(
        F.regexp_extract_all("scan", F.lit(
            rf"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)({IDENT})\s*(?:\([^()]*\)\s*)?as\s*"
            r"(?:(?:not\s+)?materialized\s*)?\(\s*(?:select|with|values|insert|update|delete|\()\b"
        ), F.lit(1)),
        _unquoted,
    )
    schema, name = _object(F.col("full"))
    own_schema, own_name = _object(F.col("target"))
    reads = (
        scanned.withColumn("ctes", ctes)
        .withColumn("full", F.explode(F.array_distinct(names)))
        .where(F.col("full") != "")
        .select("script_id", "stmt", "kind", "ctes", schema.alias("schema"), name.alias("name"),
                own_schema.alias("own_schema"), own_name.alias("own_name"))
        .where(~F.lower("name").isin(KEYWORDS))
    )
    itself = (
        ~F.col("kind").isin("insert", "create_function")
        & (F.col("schema") == F.col("own_schema")) & (F.col("name") == F.col("own_name"))
    )
    is_cte = (F.col("schema") == "") & F.array_contains("ctes", F.col("name"))
    return (
        reads.where(~itself & ~is_cte)
        .select("script_id", "stmt", "schema", "name", F.lit("relation").alias("type")).distinct()
    )


def builtin_functions(spark: SparkSession) -> list[str]:
    """Names that count as built in: Spark's functions and common database ones."""
    listed = [row[0].split(".")[-1] for row in spark.sql("SHOW SYSTEM FUNCTIONS").collect()]
    return sorted({name for name in listed if name[0].isalpha()} | set(DATABASE_BUILTINS))


def function_references(stmts: DataFrame, builtins: list[str]) -> DataFrame:
    """Functions a statement calls that are neither built in nor spatial ``st_*`` ones."""
    scanned = _scanned(stmts)
    text = F.col("scan")
    for pattern, keep in (
        (rf"(?i)\breferences\s+{NAME}\s*\(", " ("),
        # Column lists after an alias or a CTE name, and type precision.
        (rf"(?i)\bas\s+{NAME}\s*\(", " as ("),
        (rf"(?i)\b{IDENT}\s*\([^()]*\)\s*as\s*\(", " as ("),
        (rf"::\s*{NAME}\s*\(", " ("),
    ):
        text = F.regexp_replace(text, pattern, keep)
    call = F.lit(rf"({NAME})\s*\(")
    schema, name = _object(F.col("full"))
    known = F.lower("name").isin([*KEYWORDS, *TYPES]) | F.lower("name").isin(builtins)
    spatial = F.col("name").startswith("st_") & F.col("schema").isin("", "public")
    return (
        scanned.withColumn("full", F.explode(F.array_distinct(F.regexp_extract_all(text, call, 1))))
        .select("script_id", "stmt", schema.alias("schema"), name.alias("name"))
        .where(~known & ~spatial)
        .withColumn("type", F.lit("function")).distinct()
    )


def object_events(stmts: DataFrame, builtins: list[str]) -> DataFrame:
    """Event rows of all statements, as ``script_events`` expects them."""
    action = (
        F.when(F.col("kind").startswith("create_"), "create")
        .when(F.col("kind") == "drop_function", "drop")
        .otherwise(F.col("kind"))
    )
    kinds = [kind for kind, _, _ in FORMS if kind not in ("create_index", "set")]
    schema, name = _object(F.col("target"))
    # DROP may list several objects; the first is the target, the others lead the rest.
    more = F.regexp_extract("rest", rf"^((?:\s*,\s*{NAME})+)", 1)
    each = F.when(F.col("kind") == "drop", F.concat(
        F.array("target"), F.regexp_extract_all(more, F.lit(f"({NAME})"), F.lit(1)))).otherwise(F.array("target"))
    stmts_own = stmts.withColumn("target", F.explode(each))
    own = stmts_own.where(F.col("kind").isin(kinds)).select(
        "script_id", "stmt", action.alias("action"), schema.alias("schema"), name.alias("name"),
        F.when(F.col("kind").endswith("function"), "function")
        .when(F.col("target").isNotNull(), "relation").alias("type"),
        (F.col("kind") == "create_temp").alias("temp"),
    )
    reads = relation_references(stmts).unionByName(function_references(stmts, builtins))
    return own.unionByName(
        reads.withColumn("action", F.lit("reference")).withColumn("temp", F.lit(False))
    )


def form_errors(stmts: DataFrame) -> DataFrame:
    """Statements of a known kind in a form that cannot be analyzed."""
    reason = F.when(
        (F.col("kind") == "insert") & ~F.col("columns"), "insert without a column list"
    ).when(
        (F.col("kind") == "create_function") & F.col("body").isNull(),
        "function without a dollar-quoted body",
    )
    return stmts.select("script_id", "stmt", reason.alias("reason")).where("reason IS NOT NULL")
