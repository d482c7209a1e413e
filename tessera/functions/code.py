"""Checks of Python source and of error messages; source is parsed, never run."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ok(source: str | None) -> bool:
    try:
        ast.parse(source or "")
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def parses(source: Column) -> Column:
    """Whether the source is Python; parsed in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(_ok), "boolean")(source)


IMPORT = r"^\s*(?:from\s+(\S+)\s+)?import\s+([^,\s]+)"


def lint(df: DataFrame, key: str, source: str) -> DataFrame:
    """key, line (null where an issue has none), type and severity of each issue; lines and patterns are checked in the JVM."""
    lines = df.select(key, F.posexplode(F.split(source, "\n")).alias("i", "s"), F.col(source).alias("_all")).withColumn("line", F.col("i") + 1)
    issue = lambda d, kind, severity, line="line": d.select(key, F.col(line).cast("int").alias("line") if line else F.lit(None).cast("int").alias("line"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"))
    module = F.regexp_extract(F.coalesce(F.nullif(F.regexp_extract("s", IMPORT, 1), F.lit("")), F.regexp_extract("s", IMPORT, 2)), r"^([^.]*)", 1)
    rest = F.array_join(F.filter(F.split("_all", "\n"), lambda x: ~F.regexp_like(x, F.lit(r"^\s*(from|import)\s+.*"))), "\n")
    unused = lines.where(F.regexp_like("s", F.lit(IMPORT))).where(~rest.contains(module))
    out = issue(df.where(~parses(F.col(source))), "syntax_error", "error", "")
    out = out.union(issue(lines.where(F.length("s") > 120), "long_line", "warning")).union(issue(unused, "unused_import", "info"))
    out = out.union(issue(lines.where("contains(s, 'TODO') or contains(s, 'FIXME')"), "todo", "info"))
    # fixed values: slow patterns
    slow = {"range_len": r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\(", "list_add": r"\+=\s*\[", "chained_index": r"\[\w+\]\[\w+\]", "n_plus_1": r"for.+:\s*\n\s+.*\.(query|execute|find|get)\("}
    for kind, pattern in slow.items():
        out = out.union(issue(df.where(F.regexp_like(F.col(source), F.lit(pattern))), kind, "warning", ""))
    return out


def error_kind(message: Column) -> Column:
    """The first kind of error that a message names, and what it is about in some."""
    low = F.lower(message)
    has = lambda x: low.contains(x)
    kind = F.when(has("nameerror"), F.concat(F.lit("undefined:"), F.regexp_extract(message, r"name '(\w+)' is not defined", 1)))
    kind = kind.when(has("typeerror") & has("not subscriptable"), "not_subscriptable").when(has("typeerror") & has("not iterable"), "not_iterable")
    kind = kind.when(has("typeerror") & has("takes") & has("argument"), "wrong_arguments").when(has("typeerror"), "type")
    kind = kind.when(has("indexerror"), "index").when(has("keyerror"), "key")
    kind = kind.when(has("importerror") | has("modulenotfound"), F.concat(F.lit("missing:"), F.regexp_extract(message, r"No module named '(\w+)'", 1)))
    kind = kind.when(has("attributeerror"), "attribute").when(has("valueerror") & (has("convert") | has("literal")), "conversion").when(has("valueerror"), "value")
    return kind.when(has("filenotfound"), "file").otherwise("other")


# fixed values: modules that go by a short name
SHORT_NAMES = {"np": "numpy", "pd": "pandas", "plt": "matplotlib.pyplot", "sns": "seaborn", "tf": "tensorflow", "torch": "torch"}


def suggestions(message: Column) -> Column:
    """What may help against an error: code and text of each suggestion, none where the message is of no known kind.

    Kinds are looked for in the order of the table, in either case, and the first that the message names counts even if it has nothing to say.
    """
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *x: F.exists(F.array(*map(F.lit, x)), lambda y: low.contains(y))
    name = F.regexp_extract(message, r"name '(\w+)' is not defined", 1)
    module = F.regexp_extract(message, r"No module named '(\w+)'", 1)
    short = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    say = lambda code, *text: F.struct(F.lit(code).alias("code"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text]).alias("text"))
    none = F.array().cast("array<struct<code:string,text:string>>")
    undefined = say("undefined", "'", name, "' isn't defined: check its spelling, or define or import it first")
    imported = say("import", "import ", F.try_element_at(short, name), " as ", name)
    table = (
        (has("nameerror"), F.when(name == "", none).when(F.try_element_at(short, name).isNull(), F.array(undefined)).otherwise(F.array(undefined, imported))),
        (
            has("typeerror"),
            F.when(has("not subscriptable"), F.array(say("not_subscriptable", "the object takes no index: check what it is")))
            .when(has("not iterable"), F.array(say("not_iterable", "the object can't be looped over: a list or a dict can")))
            .when(has("takes") & has("argument"), F.array(say("wrong_arguments", "the number of arguments isn't that of the function")))
            .otherwise(none),
        ),
        (has("indexerror"), F.array(say("index", "the index is out of range: check the length"), say("length", "len() gives the length, try and except catch the error"))),
        (has("keyerror"), F.array(say("key", "the key isn't there: get() gives a default"), say("membership", "`key in d` tells whether it is there"))),
        (has("importerror", "modulenotfound"), F.when(module == "", none).otherwise(F.array(say("install", "the module '", module, "' isn't installed: install it with pip")))),
        (has("attributeerror"), F.array(say("attribute", "the object has no such attribute: check its type and the spelling"), say("inspect", "dir() and type() tell about the object"))),
        (has("valueerror"), F.when(has("convert", "literal"), F.array(say("conversion", "the text can't be converted: check its format"))).otherwise(F.array(say("value", "the value isn't one that is allowed: check range and format")))),
        (has("filenotfound"), F.array(say("file", "the file isn't there: check the path"), say("exists", "os.path.exists() tells whether it is there"))),
    )
    out = none
    for kind, said in reversed(table):
        out = F.when(kind, said).otherwise(out)
    return out


def _fault(source: str | None) -> dict | None:
    """Line and message of what keeps a source from being compiled; it is never run."""
    try:
        compile(source or "", "<cell>", "exec", dont_inherit=True)
    except SyntaxError as e:
        return {"line": e.lineno, "message": e.msg}
    except (ValueError, RecursionError, MemoryError) as e:
        return {"line": None, "message": str(e)}
    return None


def syntax_fault(source: Column) -> Column:
    """line and message of a source's syntax error, both null if it has none."""

    @F.pandas_udf("line int, message string")
    def faults(sources: pd.Series) -> pd.DataFrame:
        found = [_fault(s) for s in sources]
        return pd.DataFrame({"line": pd.array([x and x["line"] for x in found], dtype="Int32"), "message": [x and x["message"] for x in found]})

    return faults(source)
