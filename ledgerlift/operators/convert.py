"""Steps of source programs as SQL statements, one row per statement.

The work is on columns: a program's text is cut into steps inside its row, steps become rows, and every operand
(inputs, output, keys, variables) is read from the step's own text. Statements run on Spark as they
are; a step that cannot be carried over as a whole says so in its status and note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators.corpus import let, matches, strip_comments, unnest

# Procedures without a counterpart in SQL, those named in gap reports.
GAP_PROCS = ["LOGISTIC", "REG", "GLM", "MIXED", "IML", "REPORT", "TABULATE"]
# File kinds that SQL reads and writes as delimited text, and their separators.
DELIMITED = {"CSV": ",", "DLM": ";", "TAB": "\\t"}

CONVERTED, REVIEW, GAP = "converted", "review", "gap"


def _one(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group without outer blanks; missing if there is none."""
    got = F.trim(F.regexp_replace(F.regexp_extract(text, pattern, group), r"\s+", " "))
    return F.when(got == "", None).otherwise(got)


def _list(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _joined(words: Column, sep: str = ", ") -> Column:
    return F.array_join(words, sep)


def _named(table: Column, libraries: dict[str, str]) -> Column:
    """A data set's name in the target: its library's schema before its name; a library mapped to '' leaves the bare name."""
    low, out = F.lower(table), None
    for library, schema in libraries.items():
        inside = low.startswith(f"{library.lower()}.")
        new = F.concat(F.lit(f"{schema}." if schema else ""), F.substring(low, len(library) + 2, 1000))
        out = F.when(inside, new) if out is None else out.when(inside, new)
    return low if out is None else out.otherwise(low)


def _renamed(sql: Column, libraries: dict[str, str]) -> Column:
    for library, schema in libraries.items():
        sql = F.regexp_replace(sql, rf"(?i)\b{library}\.(?=\w)", f"{schema}." if schema else "")
    return sql


def _lit(*parts) -> Column:
    """Concatenation that is missing where a part is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _order_by(keys: Column) -> Column:
    """A BY list as an ORDER BY list: DESCENDING goes behind its name."""
    turned = F.regexp_replace(keys, r"(?i)\bDESCENDING\s+(\w+)", "$1!")
    return _joined(F.transform(_list(turned), lambda w: F.regexp_replace(w, "!$", " DESC")))


def _keys(keys: Column) -> Column:
    return _joined(F.filter(_list(keys), lambda w: F.upper(w) != "DESCENDING"))


def split_steps(programs: DataFrame) -> DataFrame:
    """(program_id, filename, place, line, step): the steps of every program in order, without comments.

    A step runs from DATA or PROC to its RUN or QUIT; LIBNAME statements and macro headers are steps, too.
    """
    clean = strip_comments(F.col("content"))
    steps = F.transform(
        let(clean, lambda text: matches(text, "step")),
        lambda m, i: F.struct((i + 1).alias("place"), m["line"].alias("line"), m["text"].alias("step")),
    )
    return unnest(programs, ["program_id", "filename"], steps)


def _kind(step: Column) -> Column:
    proc = F.upper(F.regexp_extract(step, r"(?i)^PROC\s+(\w+)", 1))
    merge = step.rlike(r"(?i)\bMERGE\s")
    return (
        F.when(step.rlike(r"(?i)^LIBNAME\b"), "LIBNAME").when(step.rlike(r"(?i)^%MACRO\b"), "MACRO")
        .when(step.rlike(r"(?i)^DATA\b"), F.when(merge, "MERGE").otherwise("DATA")).otherwise(proc)
    )


def _result(statement: Column | None, status: Column | str, note: Column | str | None = None) -> Column:
    """One candidate row; a statement with a missing operand is missing."""
    none = F.lit(None).cast("string")
    status = F.lit(status) if isinstance(status, str) else status
    note = F.lit(note).cast("string") if note is None or isinstance(note, str) else note
    return F.struct((none if statement is None else statement).alias("statement"), status.alias("status"), note.alias("note"))


def _whole(statement: Column, lacking: str) -> Column:
    """Converted where every operand was found, otherwise left for review."""
    found = statement.isNotNull()
    return F.array(_result(statement, F.when(found, CONVERTED).otherwise(REVIEW), F.when(~found, lacking)))


def _sort(step: Column, create: str, libraries: dict[str, str]) -> Column:
    head = F.regexp_extract(step, r"(?is)^PROC\s+SORT\b([^;]*);", 1)
    data = _named(_one(head, r"(?i)\bDATA\s*=\s*([\w.]+)"), libraries)
    out = F.coalesce(_named(_one(head, r"(?i)\bOUT\s*=\s*([\w.]+)"), libraries), data)
    by = _one(step, r"(?is);\s*BY\s+([^;]+);")
    first = _lit(
        create, out, " AS SELECT * EXCEPT (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY ", _keys(by), " ORDER BY ", _order_by(by),
        ") AS _rn FROM ", data, ") WHERE _rn = 1",
    )
    plain = _lit(create, out, " AS SELECT * FROM ", data, " ORDER BY ", _order_by(by))
    return _whole(F.when(head.rlike(r"(?i)\bNODUPKEY\b"), first).otherwise(plain), "input or keys not named")


def _data_of(step: Column, libraries: dict[str, str]) -> Column:
    return _named(_one(step, r"(?is)^PROC\s+\w+\b[^;]*?\bDATA\s*=\s*([\w.]+)"), libraries)


def _freq(step: Column, libraries: dict[str, str]) -> Column:
    """A statement for each request of TABLES; a*b is a cross table."""
    data = _data_of(step, libraries)
    asked = _one(step, r"(?is);\s*TABLES?\s+([^;/]+)")
    requests = _list(F.regexp_replace(asked, r"\s*\*\s*", "*"))

    def one(request: Column) -> Column:
        names = F.regexp_replace(request, r"\*", ", ")
        return _result(
            _lit("SELECT ", names, ", count(*) AS frequency, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM ", data,
                 " GROUP BY ", names, " ORDER BY frequency DESC, ", names),
            CONVERTED,
        )

    none = F.array(_result(None, REVIEW, "input or variables not named"))
    return F.when(data.isNull() | asked.isNull(), none).otherwise(F.transform(requests, one))


def _statistics(step: Column, libraries: dict[str, str], quartiles: bool) -> Column:
    data = _data_of(step, libraries)
    classes = F.when(step.rlike(r"(?i);\s*CLASS\s"), _joined(_list(_one(step, r"(?is);\s*CLASS\s+([^;/]+)")))).otherwise(F.lit(""))
    variables = _list(_one(step, r"(?is);\s*VAR\s+([^;/]+)"))
    functions = [("n", "count({0})"), ("mean", "avg({0})"), ("std", "stddev({0})"), ("min", "min({0})"), ("max", "max({0})")]
    if quartiles:
        shares = (("p25", "0.25"), ("median", "0.5"), ("p75", "0.75"))
        functions += [(name, f"percentile_cont({p}) WITHIN GROUP (ORDER BY {{0}})") for name, p in shares]

    def of(v: Column) -> Column:
        ends = [(name, *f.split("{0}")) for name, f in functions]
        return F.concat_ws(", ", *[_lit(before, v, after, " AS ", v, f"_{name}") for name, before, after in ends])

    grouped = F.when(classes == "", "").otherwise(_lit(" GROUP BY ", classes, " ORDER BY ", classes))
    led = F.when(classes == "", "").otherwise(F.concat(classes, F.lit(", ")))
    return _whole(_lit("SELECT ", led, _joined(F.transform(variables, of)), " FROM ", data, grouped), "input or variables not named")


def _sql(step: Column, create: str, libraries: dict[str, str]) -> Column:
    """The statements inside PROC SQL, tables created anew, library names replaced; host words are left for review."""
    body = F.regexp_replace(F.regexp_extract(step, r"(?is)^PROC\s+SQL\b[^;]*;(.*)\b(?:QUIT|RUN)\s*;", 1), r"\s+", " ")
    each = F.filter(F.transform(F.split(body, ";"), lambda s: F.trim(s)), lambda s: s != "")
    host = r"(?i)\bINTO\s*:|\bCALCULATED\b|&\w|%\w"

    def one(s: Column) -> Column:
        text = _renamed(F.regexp_replace(s, r"(?i)^CREATE\s+TABLE\s+", create), libraries)
        return _result(text, F.when(s.rlike(host), REVIEW).otherwise(CONVERTED), F.when(s.rlike(host), "words of the host language are left"))

    return F.when(F.size(each) == 0, F.array(_result(None, REVIEW, "no statement"))).otherwise(F.transform(each, one))


def _format(step: Column, create: str) -> Column:
    """A table (code, label) for each VALUE list; ranges are left for review."""
    lists = F.regexp_extract_all(step, F.lit(r"(?is)\bVALUE\s+\$?\w+[^;]*;"), F.lit(0))
    pair = r"(?i)['\"]?([^'\"=\s]+)['\"]?\s*=\s*['\"]([^'\"]*)['\"]"

    def one(v: Column) -> Column:
        name = F.lower(F.regexp_extract(v, r"(?i)\bVALUE\s+\$?(\w+)", 1))
        items = F.arrays_zip(
            F.regexp_extract_all(v, F.lit(pair), F.lit(1)).alias("code"), F.regexp_extract_all(v, F.lit(pair), F.lit(2)).alias("label"))
        rows = F.transform(items, lambda p: _lit("('", p["code"], "', '", p["label"], "')"))
        ranged = v.rlike(r"(?i)\d\s*-\s*<?\s*\w+\s*=|\bLOW\b|\bHIGH\b|\bOTHER\b") | (F.size(rows) == 0)
        text = _lit(create, "format_", name, " AS SELECT * FROM VALUES ", _joined(rows), " AS t(code, label)")
        return _result(F.when(~ranged, text), F.when(ranged, REVIEW).otherwise(CONVERTED), F.when(ranged, "ranges, or no labels"))

    return F.when(F.size(lists) == 0, F.array(_result(None, REVIEW, "no value list"))).otherwise(F.transform(lists, one))


def _files(step: Column, create: str, libraries: dict[str, str], export: bool) -> Column:
    dbms = F.upper(_one(step, r"(?i)\bDBMS\s*=\s*(\w+)"))
    separator = None
    for name, sep in DELIMITED.items():
        test = dbms == name
        separator = F.when(test, sep) if separator is None else separator.when(test, sep)
    separator = F.coalesce(_one(step, r"(?i)\bDELIMITER\s*=\s*['\"]([^'\"]+)['\"]"), separator)
    if export:
        path = _one(step, r"(?i)\bOUTFILE\s*=\s*['\"]([^'\"]+)['\"]")
        data = _named(_one(step, r"(?i)\bDATA\s*=\s*([\w.]+)"), libraries)
        text = _lit("INSERT OVERWRITE DIRECTORY '", path, "' USING csv OPTIONS ('header' 'true', 'sep' '", separator, "') SELECT * FROM ", data)
    else:
        path = _one(step, r"(?i)\bDATAFILE\s*=\s*['\"]([^'\"]+)['\"]")
        out = _named(_one(step, r"(?i)\bOUT\s*=\s*([\w.]+)"), libraries)
        text = _lit(create, out, " USING csv OPTIONS ('path' '", path, "', 'header' 'true', 'sep' '", separator, "')")
    readable = dbms.isin(*DELIMITED)
    other = F.array(_result(None, GAP, _lit("files of kind ", F.coalesce(dbms, F.lit("unknown")), " need another reader")))
    return F.when(F.coalesce(readable, F.lit(False)), _whole(text, "path or data set not named")).otherwise(other)


#: Statements of a DATA step that its SELECT carries.
CARRIED = r"(?is)\b(?:SET|MERGE|BY|WHERE|KEEP|DROP)\b[^;]*;|\bIF\s+(?:NOT\s+)?\w+(?:\s+AND\s+\w+)*\s*;|\bRUN\s*;"


def _columns(step: Column) -> Column:
    head = F.regexp_extract(step, r"(?is)^DATA\s+([^;]+);", 1)
    keep = F.coalesce(_one(head, r"(?i)\bKEEP\s*=\s*([\w\s]+)"), _one(step, r"(?is);\s*KEEP\s+([^;]+);"))
    drop = F.coalesce(_one(head, r"(?i)\bDROP\s*=\s*([\w\s]+)"), _one(step, r"(?is);\s*DROP\s+([^;]+);"))
    kept = F.regexp_replace(keep, r"(?i)\s+(?:DROP|RENAME|WHERE|LABEL|COMPRESS)\s*$", "")
    return F.when(kept.isNotNull(), _joined(_list(kept))).when(drop.isNotNull(), _lit("* EXCEPT (", _joined(_list(drop)), ")")).otherwise("*")


def _data(step: Column, create: str, libraries: dict[str, str], merge: bool) -> Column:
    """SET as a SELECT (several inputs are appended), MERGE with BY as joins by its IN= flags; what else a step does goes into the note."""
    head = F.regexp_extract(step, r"(?is)^DATA\s+([^;]+);", 1)
    target = _named(_one(head, r"^\s*([\w.]+)"), libraries)
    body = F.regexp_extract(step, r"(?is)^DATA\s+[^;]+;(.*)$", 1)
    where = _one(body, r"(?is)\bWHERE\s+([^;]+);")
    filtered = F.when(where.isNull(), "").otherwise(_lit(" WHERE ", where))
    inputs = _one(body, rf"(?is)\b{'MERGE' if merge else 'SET'}\s+([^;]+);")
    flags = F.regexp_extract_all(inputs, F.lit(r"(?i)\(\s*IN\s*=\s*(\w+)\s*\)"), F.lit(1))
    tables = F.transform(_list(F.regexp_replace(inputs, r"\([^)]*\)", " ")), lambda t: _named(t, libraries))
    left = F.trim(F.regexp_replace(F.regexp_replace(body, CARRIED, " "), r"\s+", " "))
    if merge:
        by = _keys(_one(body, r"(?is)\bBY\s+([^;]+);"))
        test = F.lower(_one(body, r"(?is)\bIF\s+(\w+(?:\s+AND\s+\w+)*)\s*;"))
        first, second = (F.lower(F.get(flags, F.lit(i))) for i in (0, 1))
        how = (
            F.when(test.isNull(), "FULL JOIN").when(test == first, "LEFT JOIN").when(test == second, "RIGHT JOIN")
            .when(test.isin(_lit(first, " and ", second), _lit(second, " and ", first)), "JOIN")
        )
        source = _lit(F.get(tables, F.lit(0)), " ", how, " ", F.get(tables, F.lit(1)), " USING (", by, ")")
        source = F.when(F.size(tables) == 2, source)
        text = _lit(create, target, " AS SELECT ", _columns(step), " FROM ", source, filtered)
        lacking = "more than two inputs, no keys, or another condition"
    else:
        reads = F.transform(tables, lambda t: _lit("SELECT ", _columns(step), " FROM ", t, filtered))
        text = F.when(inputs.isNotNull(), _lit(create, target, " AS ", _joined(reads, " UNION ALL ")))
        lacking = "no input data set"
    gap = F.when(body.rlike(r"(?i)DECLARE\s+HASH|_NEW_\s*HASH"), "hash object: join with the lookup table").when(
        body.rlike(r"(?i)CALL\s+EXECUTE"), "code made at run time")
    note = F.coalesce(gap, F.when(text.isNull(), lacking), F.when(left != "", _lit("left: ", left)))
    status = F.when(gap.isNotNull(), GAP).when(text.isNull() | (left != ""), REVIEW).otherwise(CONVERTED)
    return F.array(_result(text, status, note))


def convert_steps(programs: DataFrame, libraries: dict[str, str], into: str = "TABLE") -> DataFrame:
    """(program_id, filename, place, line, kind, part, status, statement, note): every step as statements in order.

    `libraries` maps library names to schemas ('' for the session's own, as WORK); a library it does not
    name keeps its name and its LIBNAME statement is left for review. `into` is what steps create, TABLE or TEMP
    VIEW. Status `converted` means the statement does all the step does, `review` that operands or statements are
    left (in the note), `gap` that the step has no counterpart.

    Steps are rows of their own from the first transformation on, so a long program is spread with the others;
    nothing is shuffled. A program without steps has no rows.
    """
    create = f"CREATE OR REPLACE {into} "
    step = F.col("step")
    kind = F.col("kind")
    name = F.lower(_one(step, r"(?i)^LIBNAME\s+(\w+)"))
    schema = None
    for library, target in libraries.items():
        test = name == library.lower()
        schema = F.when(test, F.lit(target)) if schema is None else schema.when(test, F.lit(target))
    schema = F.lit(None).cast("string") if schema is None else schema
    use, unknown = F.when(schema != "", _lit("USE ", schema)), schema.isNull()
    rows = (
        F.when(kind == "LIBNAME", F.array(_result(
            use, F.when(unknown, REVIEW).otherwise(CONVERTED), F.when(unknown, _lit("no schema for library ", name)).when(schema == "", "the session's own schema"))))
        .when(kind == "MACRO", F.array(_result(None, REVIEW, "macro: make its steps a function of its parameters")))
        .when(kind == "SORT", _sort(step, create, libraries))
        .when(kind == "SQL", _sql(step, create, libraries))
        .when(kind == "FREQ", _freq(step, libraries))
        .when(kind.isin("MEANS", "SUMMARY"), _statistics(step, libraries, False))
        .when(kind == "UNIVARIATE", _statistics(step, libraries, True))
        .when(kind == "FORMAT", _format(step, create))
        .when(kind == "IMPORT", _files(step, create, libraries, False))
        .when(kind == "EXPORT", _files(step, create, libraries, True))
        .when(kind == "MERGE", _data(step, create, libraries, True))
        .when(kind == "DATA", _data(step, create, libraries, False))
        .when(kind.isin(GAP_PROCS), F.array(_result(None, GAP, _lit("no counterpart of ", kind, " in SQL"))))
        .otherwise(F.array(_result(None, REVIEW, _lit("procedure ", kind, " is not covered"))))
    )
    cut = split_steps(programs).withColumn("step", F.trim("step"))
    named = cut.withColumn("kind", _kind(step)).withColumn("rows", rows)
    out = named.select("program_id", "filename", "place", "line", "kind", F.posexplode_outer("rows").alias("part", "row"))
    return out.select("program_id", "filename", "place", "line", "kind", (F.col("part") + 1).alias("part"), "row.status", "row.statement", "row.note")


def converted_programs(steps: DataFrame) -> DataFrame:
    """Per program: its statements as one script (what is left stands in it as comments), counts by status, share converted."""
    head = _lit("-- line ", F.col("line").cast("string"), ", ", F.col("kind"), F.when(F.col("status") == CONVERTED, "").otherwise(
        _lit(": ", F.col("status"), F.coalesce(_lit(", ", F.col("note")), F.lit("")))))
    piece = F.concat(head, F.coalesce(_lit("\n", F.col("statement"), ";"), F.lit("")))
    counted = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    script = F.array_join(F.sort_array(F.collect_list(F.struct("place", "part", piece.alias("text"))))["text"], "\n\n")
    return steps.groupBy("program_id", "filename").agg(
        F.count(F.lit(1)).alias("statements"), counted(CONVERTED), counted(REVIEW), counted(GAP),
        F.round(100.0 * F.count(F.when(F.col("status") == CONVERTED, 1)) / F.count(F.lit(1)), 1).alias("share"), script.alias("script"),
    )
