"""Facts extracted from program text, as column expressions over one content column.

Every extraction works inside the row that holds the text, so a corpus is read once and
nothing is shuffled. Set-valued facts come out distinct and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the recognised statements. U = Unicode classes, i = any case,
# s = dot matches line ends, m = line anchors, d = only \n ends a line.
PATTERNS = {
    "libname": r"""(?Ui)LIBNAME\s+(\w+)\s+['"]?([^;'"]+)""",
    "data_step": r"(?Uis)DATA\s+([\w.]+(?:\s*\(.*?\))?(?:\s+[\w.]+(?:\s*\(.*?\))?)*);\s",
    "set": r"(?Ui)\bSET\s+([\w.]+)",
    "merge": r"(?Ui)\bMERGE\s+([\w.]+(?:\s*\([^)]*\))?\s+[\w.]+(?:\s*\([^)]*\))?)",
    "proc": r"(?Ui)\bPROC\s+(\w+)",
    "from": r"(?Ui)\bFROM\s+([\w.]+)",
    "join": r"(?Ui)\bJOIN\s+([\w.]+)",
    "macro_def": r"(?Ui)%MACRO\s+(\w+)",
    "macro_call": r"(?U)%(\w+)\s*\(",
    "sql_create": r"(?Ui)CREATE\s+TABLE\s+([\w.]+)\s+AS",
    "hash": r"(?Ui)DECLARE\s+HASH|_NEW_\s*HASH",
    "dynamic": r"(?Ui)CALL\s+EXECUTE|%SYSFUNC",
    "include": r"""(?Ui)%INCLUDE\s+['"]?([^;'"]+)""",
    "let": r"(?Ui)%LET\s+(\w+)\s*=\s*([^;]*);",
    "proc_import": r"""(?Uis)PROC\s+IMPORT\s+.*?DATAFILE\s*=\s*['"]?([^;'"]+)['"]?.*?OUT\s*=\s*([\w.&]+).*?DBMS\s*=\s*(\w+)""",
    "proc_export": r"""(?Uis)PROC\s+EXPORT\s+.*?DATA\s*=\s*([\w.&]+).*?OUTFILE\s*=\s*['"]?([^;'"]+)['"]?.*?DBMS\s*=\s*(\w+)""",
    "filename": r"""(?Ui)FILENAME\s+(\w+)\s+(?:ZIP\s+)?['"]?([^;'"]+)""",
    "filename_zip": r"(?Ui)FILENAME\s+\w+\s+ZIP",
    "infile": r"""(?Ui)INFILE\s+['"]?([^;'"]+)""",
    "named_literal": r'(?Ui)"[^"]+?"n',
    "unc_path": r"""\\\\[a-zA-Z0-9_\-]+\\[^\s;'"]+""",
    "format_spec": r"(?Ui)\b(COMMAX|COMMA|DDMMYY|MMDDYY|YYMMDD|DATE|DATETIME|BEST|DOLLAR|PERCENT)\d*\.?\d*",
    "left_join": r"(?Ui)\bLEFT\s+JOIN\b",
    "inner_join": r"(?Ui)\bINNER\s+JOIN\b",
    "if_then": r"(?Uid)\bIF\b.*?\bTHEN\b",
    "keep": r"(?Ui)\bKEEP\s+([\w\s]+);",
    "drop": r"(?Ui)\bDROP\s+([\w\s]+);",
    "keep_option": r"(?Ui)\(\s*keep\s*=\s*([\w\s]+)\)",
    "name": r"(?U)\b([A-Za-z_]\w*)\b",
    "word": r"(?U)([\w.]+)",
    "assignment": r"(?Udm)^\s*([A-Za-z_]\w*)\s*=[^=]",
    "account": r"(?U)\bC\d{7,}\b",
    "account_assigned": r"(?Udm)^\s*(C\d{7,})\s*=",
    "block_comment": r"(?s)/\*.*?\*/",
    "line_comment": r"(?Udm)^\s*\*[^;]*;",
    "data_block": r"(?Uis)\bDATA\s+([^;]+);(.*?)\bRUN\s*;",
    "set_source": r"""(?Ui)\bSET\s+([\w."&]+)""",
    "format_block": r"(?Uis)\bFORMAT\b\s+(.*?);",
    "length_block": r"(?Uis)\bLENGTH\b\s+(.*?);",
    "attrib_block": r"(?Uis)\bATTRIB\b\s+(.*?);",
    "sql_select": r"(?Ui)CREATE\s+TABLE\s+([\w.]+)\s+AS\s+SELECT",
    "sql_end": r"(?Uidm);\s*$|QUIT",
    "alias": r"(?Ui)\bAS\s+(\w+)",
    "value_map": r"""(?Ui)(?:ELSE\s+)?IF\s+(\w+)\s*=\s*['"]([^'"]+)['"]\s*THEN\s+(\w+)\s*=\s*['"]([^'"]+)['"]""",
    "section_direct": r"""(?Ui)cod_tp_emissao\s*=\s*['"]D['"]""",
    "section_accepted": r"""(?Ui)cod_tp_emissao\s*=\s*['"]A['"]""",
    "section_summary": r"(?Uid)resumo.*aging|RESUMO_AGING",
    "section_reconciliation": r"(?Ui)concilia[çc][ãa]o",
    "export_outfile": r"""(?Uis)PROC\s+EXPORT.*?OUTFILE\s*=\s*['"]?([^;'"]+)""",
    "infile_path": r"""(?Ui)INFILE\s+['"]([^;'"]+)""",
    "import_datafile": r"""(?Uis)PROC\s+IMPORT.*?DATAFILE\s*=\s*['"]?([^;'"]+)""",
    "formula": r"(?Udm)^\s*([A-Za-z_]\w*)\s*=\s*(.+?);\s*$",
    "step": r"(?Uis)\bPROC\s+\w+\b.*?\b(?:RUN|QUIT)\s*;|\bDATA\s+[^;=\s][^;]*;.*?\bRUN\s*;|\bLIBNAME\s+\w+[^;]*;|%MACRO\s+\w+[^;]*;",
    "format_like": r"(?Ui)^(?:COMMAX|COMMA|DDMMYY|MMDDYY|YYMMDD|DATE|DATETIME|BEST|DOLLAR|PERCENT|\$?CHAR|Z|FORMAT|INFORMAT)",
}
# Macro names that belong to the language.
BUILTIN_MACROS = [
    "if", "then", "else", "do", "end", "let", "put", "str", "scan", "substr", "eval", "sysevalf", "sysfunc",
    "nrstr", "bquote", "superq", "global", "local", "mend", "macro", "include", "run", "quit", "length",
    "index", "upcase", "lowcase",
]
# Words that are never variable names.
KEYWORDS = [
    "IF", "THEN", "ELSE", "DO", "END", "SET", "MERGE", "BY", "WHERE", "AND", "OR", "NOT", "IN", "AS",
    "FROM", "SELECT", "ON", "OUTPUT", "DELETE", "KEEP", "DROP", "RENAME", "FORMAT", "INFORMAT", "LENGTH",
    "ATTRIB", "LABEL", "RUN", "QUIT", "DATA", "PROC", "NOTIN", "CALCULATED",
]
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def found(text: Column, name: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(group))


def let(value: Column, body) -> Column:
    """`body` of a value worked out once; inside a lambda a plain column would be redone per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has(text: Column, name: str) -> Column:
    return text.rlike(PATTERNS[name])


def as_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def texts(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _trimmed(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))


def _upper(values: Column) -> Column:
    return F.transform(values, F.upper)


def _records(text: Column, pattern: str, /, **fields) -> Column:
    """Array of structs, one per match; each field names a group and how to clean it."""
    names = list(fields)
    zipped = F.arrays_zip(*[fields[n][1](found(text, pattern, fields[n][0])) for n in names])
    return F.transform(zipped, lambda r: F.struct(*[r[str(i)].alias(n) for i, n in enumerate(names)]))


def _same(values: Column) -> Column:
    return values


def libnames(text: Column) -> Column:
    return _records(text, "libname", name=(1, _upper), path_or_engine=(2, _trimmed))


def data_steps(text: Column) -> Column:
    """Targets in order; parenthesised options are removed word by word."""
    words = F.flatten(F.transform(found(text, "data_step"), lambda t: F.split(F.trim(t), r"(?U)\s+")))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"(?d)\(.*?\)", ""))
    return F.filter(bare, lambda w: (w != "") & ~w.startswith("("))


def procs(text: Column) -> Column:
    return as_set(_upper(found(text, "proc")))


def merge_words(text: Column) -> Column:
    return F.flatten(F.transform(found(text, "merge"), lambda m: found(m, "word")))


def datasets_read(text: Column) -> Column:
    return as_set(F.concat(found(text, "set"), merge_words(text), found(text, "from"), found(text, "join")))


def datasets_written(text: Column) -> Column:
    return as_set(F.concat(data_steps(text), found(text, "sql_create")))


def macro_definitions(text: Column) -> Column:
    return found(text, "macro_def")


def macro_calls(text: Column) -> Column:
    return as_set(F.filter(found(text, "macro_call"), lambda n: ~F.lower(n).isin(BUILTIN_MACROS)))


def includes(text: Column) -> Column:
    return _trimmed(found(text, "include"))


def macro_variables(text: Column) -> Column:
    return _records(text, "let", name=(1, _same), value=(2, _trimmed))


def proc_imports(text: Column) -> Column:
    return _records(text, "proc_import", datafile=(1, _trimmed), out_dataset=(2, _same), dbms=(3, _upper))


def proc_exports(text: Column) -> Column:
    return _records(text, "proc_export", data=(1, _same), outfile=(2, _trimmed), dbms=(3, _upper))


def filenames(text: Column) -> Column:
    return _records(text, "filename", fileref=(1, _same), path=(2, _trimmed))


def infiles(text: Column) -> Column:
    return _trimmed(found(text, "infile"))


def format_specs(text: Column) -> Column:
    return as_set(_upper(found(text, "format_spec", 0)))


def named_literals(text: Column) -> Column:
    return as_set(found(text, "named_literal", 0))


def unc_paths(text: Column) -> Column:
    return as_set(found(text, "unc_path", 0))


def join_count(text: Column) -> Column:
    return F.size(found(text, "left_join", 0)) + F.size(found(text, "inner_join", 0))


def if_then_chains(text: Column) -> Column:
    return F.size(found(text, "if_then", 0))


def line_count(text: Column) -> Column:
    ends = F.regexp_count(text, F.lit(LINE_END))
    closed = (text == "") | text.rlike(f"(?:{LINE_END})\\z")
    return ends + F.when(closed, 0).otherwise(1)


def keep_variables(text: Column) -> Column:
    return as_set(_upper(F.flatten(F.transform(found(text, "keep"), lambda k: found(k, "name")))))


def variable_assignments(text: Column) -> Column:
    return as_set(_upper(found(text, "assignment")))


def accounts(text: Column) -> Column:
    assigned, referenced = as_set(found(text, "account_assigned")), as_set(found(text, "account", 0))
    return F.struct(
        assigned.alias("assigned"),
        referenced.alias("referenced"),
        F.array_except(referenced, assigned).alias("referenced_but_not_assigned"),
    )


def sections(text: Column) -> Column:
    kinds = ["direct", "accepted", "summary", "reconciliation"]
    return F.struct(*[has(text, f"section_{k}").alias(k) for k in kinds])


# Words in an export file name, all of which must occur, and the type they mean.
EXPORT_TYPES = [
    (["sap", "direto"], "sap_direto"),
    (["sap", "aceito"], "sap_aceito"),
    (["analitica", "direto"], "base_analitica_direto"),
    (["analitica", "aceito"], "base_analitica_aceito"),
    (["analitica", "vencido"], "base_analitica_vencido"),
    (["concilia"], "conciliacao"),
    (["resumo"], "resumo_aging"),
    (["aging"], "resumo_aging"),
    (["usd"], "moeda_estrangeira"),
    (["moeda"], "moeda_estrangeira"),
]


def export_type(outfile: Column) -> Column:
    lowered, out = F.lower(outfile), None
    for words, label in EXPORT_TYPES:
        test = lowered.contains(words[0])
        for w in words[1:]:
            test = test & lowered.contains(w)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit("outro"))


def export_types(text: Column) -> Column:
    return as_set(F.transform(proc_exports(text), lambda e: export_type(e["outfile"])))


FIELDS = {
    "line_count": line_count,
    "size_bytes": lambda t: F.octet_length(t).cast("bigint"),
    "libnames": libnames,
    "data_steps": data_steps,
    "procs_used": procs,
    "datasets_read": datasets_read,
    "datasets_written": datasets_written,
    "macro_definitions": macro_definitions,
    "macro_calls": macro_calls,
    "macro_variables": macro_variables,
    "merge_statements": merge_words,
    "includes": includes,
    "has_hash_objects": lambda t: has(t, "hash"),
    "has_dynamic_sql": lambda t: has(t, "dynamic"),
    "proc_imports": proc_imports,
    "proc_exports": proc_exports,
    "filenames": filenames,
    "infile_statements": infiles,
    "format_specs": format_specs,
    "named_literals": named_literals,
    "unc_paths": unc_paths,
    "join_count": join_count,
    "if_then_chains": if_then_chains,
    "has_zip_processing": lambda t: has(t, "filename_zip"),
    "has_infile_processing": lambda t: has(t, "infile"),
    "keep_variables": keep_variables,
    "variable_assignments": variable_assignments,
    "accounting_variables": accounts,
}


# --- text without comments ---------------------------------------------------------------


def _blanked(text: Column, name: str) -> Column:
    """Matches replaced by blanks of their length, line ends kept."""
    pattern = PATTERNS[name]
    gaps = F.split(text, pattern, -1)
    blanks = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda c: F.regexp_replace(c, "[^\n]", " ")
    )
    return F.array_join(F.zip_with(gaps, blanks, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")


def strip_comments(text: Column) -> Column:
    return _blanked(_blanked(text, "block_comment"), "line_comment")


def extract(programs: DataFrame, *fields: str, clean: bool = False, content: str = "content") -> DataFrame:
    """Add the named facts (all of them without names); `clean` reads the text without comments."""
    text = F.col(content)
    if clean:
        programs = programs.withColumn("_clean", strip_comments(text))
        text = F.col("_clean")
    names = fields or FIELDS
    return programs.withColumns({n: FIELDS[n](text) for n in names}).drop("_clean")


def parse_programs(programs: DataFrame, clean: bool = False) -> DataFrame:
    """One row per program with every fact; the text itself is left behind."""
    return extract(programs, clean=clean).drop("content")


# --- positions, steps and value maps -----------------------------------------------------


def _line_ends(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


# Words that name the section of what follows them; text before any of them is general.
SECTION_WORDS = ["aceito", "resumo"]


def matches(text: Column, name: str, sections: bool = False) -> Column:
    """Array of (text, line, place): each match, the line it starts on and its character offset.

    One fold over the pieces carries the offsets, so a text costs as much as it has pieces. With
    `sections` each match also has the last section word before it, or an empty text.
    """

    def folded(b: Column) -> Column:
        pieces = F.zip_with(b["gaps"], b["hits"], lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        start = F.struct(
            F.lit(1).alias("line"), F.lit(0).alias("place"), F.lit("").alias("section"), F.lit("").alias("before"),
            F.array().cast("array<struct<text:string,line:int,place:int,section:string>>").alias("out"),
        )

        def step(acc: Column, p: Column) -> Column:
            line, place = acc["line"] + _line_ends(p["gap"]), acc["place"] + F.length(p["gap"])
            if sections:
                word = F.regexp_extract(F.lower(F.concat(acc["before"], p["gap"])), f"(?s)\\A.*({'|'.join(SECTION_WORDS)})", 1)
                section = F.when(word == "", acc["section"]).otherwise(word)
            else:
                section = acc["section"]
            hit = F.struct(p["hit"].alias("text"), line.alias("line"), place.alias("place"), section.alias("section"))
            return F.struct(
                (line + _line_ends(p["hit"])).alias("line"), (place + F.length(p["hit"])).alias("place"), section.alias("section"),
                (p["hit"] if sections else acc["before"]).alias("before"),
                F.concat(acc["out"], F.array(hit)).alias("out"),
            )

        met = F.filter(pieces, lambda p: p["hit"].isNotNull())
        return F.aggregate(met, start, step, lambda acc: acc["out"])

    return let(F.struct(found(text, name, 0).alias("hits"), F.split(text, PATTERNS[name], -1).alias("gaps")), folded)


def _group(text: Column, name: str, group: int) -> Column:
    return F.regexp_extract(text, PATTERNS[name], group)


def _names(text: Column) -> Column:
    return F.filter(_upper(found(text, "name")), lambda n: ~n.isin(KEYWORDS))


def _declared(body: Column, name: str) -> Column:
    found_names = F.flatten(F.transform(found(body, name), _names))
    return as_set(F.filter(found_names, lambda n: ~n.rlike(PATTERNS["format_like"])))


def _formatted(body: Column) -> Column:
    """Names in FORMAT statements that are followed by a format with a width."""

    def of_block(block: Column) -> Column:
        return let(F.filter(F.split(block, r"(?U)\s+"), lambda t: t != ""), of_tokens)

    def of_tokens(tokens: Column) -> Column:
        pairs = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.get(tokens, i + 1).alias("next")))
        usable = F.filter(
            pairs,
            lambda p: p["t"].rlike(r"(?U)^[A-Za-z_]\w*$")
            & ~p["t"].rlike(PATTERNS["format_like"])
            & ~F.upper(p["t"]).isin(KEYWORDS)
            & F.coalesce(p["next"].rlike(r"(?U)\d+\."), F.lit(False)),
        )
        return F.transform(usable, lambda p: F.upper(p["t"]))

    return as_set(F.flatten(F.transform(found(body, "format_block"), of_block)))


SCOPE_FIELDS = [
    "target", "start_line", "set_sources", "assigned", "length_vars", "format_vars", "attrib_vars",
    "keep_vars", "drop_vars", "defined", "acct_referenced", "body",
]


def step_scopes(clean: Column) -> Column:
    """One struct per DATA ... RUN block of a comment-free text."""

    def scope(m: Column) -> Column:
        parts = F.struct(
            _group(m["text"], "data_block", 1).alias("head"), _group(m["text"], "data_block", 2).alias("body"),
            m["line"].alias("line"),
        )
        return let(parts, lambda p: let(declared(p), facts))

    def declared(p: Column) -> Column:
        return F.struct(
            p["head"].alias("head"), p["body"].alias("body"), p["line"].alias("line"),
            as_set(F.filter(_upper(found(p["body"], "assignment")), lambda n: ~n.isin(KEYWORDS))).alias("assigned"),
            _declared(p["body"], "length_block").alias("length_vars"),
            _formatted(p["body"]).alias("format_vars"),
            _declared(p["body"], "attrib_block").alias("attrib_vars"),
        )

    def facts(p: Column) -> Column:
        head, body = p["head"], p["body"]
        target = F.upper(F.get(F.split(F.trim(F.regexp_replace(head, r"(?d)\(.*?\)", "")), r"(?U)\s+"), F.lit(0)))
        sources = F.transform(found(body, "set_source"), lambda s: F.upper(F.translate(s, "\"'", "")))
        kept = F.concat(
            F.flatten(F.transform(found(body, "keep"), _names)),
            F.flatten(F.transform(found(head, "keep_option"), _names)),
        )
        dropped = F.flatten(F.transform(found(body, "drop"), _names))
        own = ["assigned", "length_vars", "format_vars", "attrib_vars"]
        return F.struct(
            target.alias("target"), p["line"].alias("start_line"), sources.alias("set_sources"),
            *[p[f].alias(f) for f in own],
            as_set(kept).alias("keep_vars"), as_set(dropped).alias("drop_vars"),
            as_set(F.concat(*[p[f] for f in own])).alias("defined"),
            as_set(found(body, "account", 0)).alias("acct_referenced"), body.alias("body"),
        )

    return F.transform(matches(clean, "data_block"), scope)


def sql_creates(clean: Column) -> Column:
    """One struct per CREATE TABLE ... AS SELECT: table, line, column aliases up to the statement's end."""

    def table(m: Column) -> Column:
        rest = F.substring(clean, m["place"] + 1, F.length(clean))
        end = F.regexp_instr(rest, F.lit(PATTERNS["sql_end"]))
        body = F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
        aliases = F.filter(_upper(found(body, "alias")), lambda a: ~a.isin(KEYWORDS))
        return F.struct(
            F.upper(_group(m["text"], "sql_select", 1)).alias("table"), m["line"].alias("start_line"),
            as_set(aliases).alias("aliases"),
        )

    return F.transform(matches(clean, "sql_select"), table)


def value_maps(text: Column) -> Column:
    """One struct per IF v='x' THEN t='y' with its line and the section named last before it."""

    def entry(m: Column) -> Column:
        section = F.when(m["section"] == "", "geral").otherwise(m["section"])
        return F.struct(
            F.upper(_group(m["text"], "value_map", 1)).alias("src_var"),
            _group(m["text"], "value_map", 2).alias("src_val"),
            F.upper(_group(m["text"], "value_map", 3)).alias("tgt_var"),
            _group(m["text"], "value_map", 4).alias("tgt_val"),
            m["line"].alias("line"), section.alias("section"),
        )

    return F.transform(matches(text, "value_map", sections=True), entry)


def unnest(df: DataFrame, keep: list[str], items: Column) -> DataFrame:
    """One row per element, structs spread into columns; empty arrays give no row.

    An inner explode would make the optimiser test the array's size at the scan as well and
    so work the whole array out twice; an outer one with the empty rows dropped does not.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias("_place", "_item")).where("_place is not null")
    return rows.select(*keep, "_item.*")


def with_clean(programs: DataFrame) -> DataFrame:
    return programs.withColumn("clean", strip_comments(F.col("content")))


def steps_table(programs: DataFrame) -> DataFrame:
    """One row per DATA step of every program."""
    numbered = F.transform(
        step_scopes(F.col("clean")), lambda s, i: F.struct(i.alias("step_no"), *[s[f].alias(f) for f in SCOPE_FIELDS])
    )
    return unnest(with_clean(programs), ["program_id", "filename"], numbered)


def sql_creates_table(programs: DataFrame) -> DataFrame:
    return unnest(with_clean(programs), ["program_id", "filename"], sql_creates(F.col("clean")))


def value_maps_table(programs: DataFrame) -> DataFrame:
    return unnest(programs, ["program_id", "filename"], value_maps(F.col("content")))
