"""Integrity rules over program text, each giving rows of findings.

`facts` reads the text once and gives one row per program: the hits of the rules about one program, worked
out as array expressions inside its row, and what the rules that compare programs need. All rules
read that table; `find_all` writes it once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions.scalars import path_stem
from ledgerlift.operators import corpus as C
from ledgerlift.operators.reshape import coverage_gaps
from ledgerlift.session import stored

# Severity and recommendation type of each finding category.
CATEGORIES = {
    "VARIAVEL_CONTABIL_INDEFINIDA": ("CRITICAL", "CORRECAO_CODIGO"),
    "VARIAVEL_CONTABIL_INEXISTENTE": ("CRITICAL", "EXTRACAO_MANUAL"),
    "KEEP_VARIAVEL_INDEFINIDA": ("HIGH", "CORRECAO_CODIGO"),
    "FORMULA_REFERENCIA_INDEFINIDA": ("CRITICAL", "EXTRACAO_MANUAL"),
    "AUTO_REIMPORTACAO": ("HIGH", "CONFIGURACAO_EXPORT"),
    "MAPEAMENTO_ELSE_COMENTADO": ("MEDIUM", "REVISAO_MANUAL"),
    "MAPEAMENTO_SEM_ELSE": ("MEDIUM", "CONFIGURACAO_EXPORT"),
    "SECAO_AUSENTE": ("CRITICAL", "EXTRACAO_MANUAL"),
    "CONTA_CONTABIL_AUSENTE": ("HIGH", "REVISAO_MANUAL"),
    "MAPEAMENTO_INCONSISTENTE_INTERNO": ("MEDIUM", "CORRECAO_CODIGO"),
    "MAPEAMENTO_DIVERGENTE_ENTRE_PROGRAMAS": ("LOW", "REVISAO_MANUAL"),
    "EXPORT_AUSENTE": ("HIGH", "EXTRACAO_MANUAL"),
}
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
# What each finding says about its subject and target.
MESSAGES = {
    "VARIAVEL_CONTABIL_INDEFINIDA": "kept in {target} but computed only where no SET reaches it: {subject}",
    "VARIAVEL_CONTABIL_INEXISTENTE": "used in {target} but computed nowhere in the program: {subject}",
    "KEEP_VARIAVEL_INDEFINIDA": "kept in {target} without a definition: {subject}",
    "FORMULA_REFERENCIA_INDEFINIDA": "formula of {target} uses an undefined account: {subject}",
    "AUTO_REIMPORTACAO": "exported file {target} is read back as {subject}",
    "MAPEAMENTO_ELSE_COMENTADO": "last ELSE of the mapping to {target} is commented out: {subject}",
    "MAPEAMENTO_SEM_ELSE": "mapping to {target} has no ELSE: {subject}",
    "SECAO_AUSENTE": "section present in related programs is absent: {subject}",
    "CONTA_CONTABIL_AUSENTE": "accounts computed by related programs are absent: {subject}",
    "MAPEAMENTO_INCONSISTENTE_INTERNO": "values mapped in the general section are absent from the accepted one: {subject}",
    "MAPEAMENTO_DIVERGENTE_ENTRE_PROGRAMAS": "values mapped by other programs are absent: {subject}",
    "EXPORT_AUSENTE": "file types exported by related programs are absent: {subject}",
}
# What each finding means for the numbers, and what to do about it.
IMPACTS = {
    "VARIAVEL_CONTABIL_INDEFINIDA": "the account is empty in this dataset and its postings are lost",
    "VARIAVEL_CONTABIL_INEXISTENTE": "the account is empty everywhere and must come from outside the program",
    "KEEP_VARIAVEL_INDEFINIDA": "the kept column is missing in the output",
    "FORMULA_REFERENCIA_INDEFINIDA": "the formula gives a missing or too small amount",
    "AUTO_REIMPORTACAO": "the result depends on the file of an earlier run",
    "MAPEAMENTO_ELSE_COMENTADO": "a new source value keeps its raw or an empty label",
    "MAPEAMENTO_SEM_ELSE": "a value outside the mapping has no label",
    "SECAO_AUSENTE": "a part of the business that related programs report is left out",
    "CONTA_CONTABIL_AUSENTE": "accounts that related programs post are not posted here",
    "MAPEAMENTO_INCONSISTENTE_INTERNO": "the same value is labelled in one section and not in the other",
    "MAPEAMENTO_DIVERGENTE_ENTRE_PROGRAMAS": "programs label the same value differently",
    "EXPORT_AUSENTE": "a file that related programs deliver is not delivered",
}
ADVICE = {
    "VARIAVEL_CONTABIL_INDEFINIDA": "compute the account in this step or read it from the step that does",
    "VARIAVEL_CONTABIL_INEXISTENTE": "find the account's source and add its formula",
    "KEEP_VARIAVEL_INDEFINIDA": "define the column or take it off the list",
    "FORMULA_REFERENCIA_INDEFINIDA": "define the referenced account before the formula",
    "AUTO_REIMPORTACAO": "separate what is exported from what is read",
    "MAPEAMENTO_ELSE_COMENTADO": "put the last branch back or name the values it stood for",
    "MAPEAMENTO_SEM_ELSE": "add a last branch for all other values",
    "SECAO_AUSENTE": "confirm that the section is not needed or add it",
    "CONTA_CONTABIL_AUSENTE": "compare the accounts with the related programs",
    "MAPEAMENTO_INCONSISTENTE_INTERNO": "use one mapping for both sections",
    "MAPEAMENTO_DIVERGENTE_ENTRE_PROGRAMAS": "keep the mapping in one shared table",
    "EXPORT_AUSENTE": "add the export or record why it is not needed",
}
MAPPED_VARIABLE = "SISTEMA_ORIGEM"
# Export types of the accepted business, and of a main program.
ACCEPTED_EXPORTS = ["base_analitica_aceito", "sap_aceito"]
MAIN_EXPORTS = ["sap_direto", "sap_aceito", "base_analitica_direto", "base_analitica_aceito"]
ACCOUNT = r"^C\d{7,}$"
STEP_END = r"(?Ui)^\s*(?:RUN|QUIT)\s*;"

NO_TEXTS = "array<string>"


def _none() -> Column:
    return F.array().cast(NO_TEXTS)


def _hit(line: Column, subject: Column, target: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), subject.alias("subject"), target.alias("target"))


def registry(scopes: Column, creates: Column) -> Column:
    """Map dataset -> known variables, built in program order.

    A step knows its own variables and those of SET sources registered before it; a later
    step of the same name replaces the entry; aliases of created tables are added last.
    """
    empty = F.expr("cast(map() as map<string, array<string>>)")

    def entry(acc: Column, name: Column) -> Column:
        return F.coalesce(F.try_element_at(acc, name), _none())

    def put(acc: Column, name: Column, values: Column) -> Column:
        return F.map_concat(F.map_filter(acc, lambda k, _: k != name), F.create_map(name, values))

    def step(acc: Column, s: Column) -> Column:
        inherited = F.flatten(F.transform(s["set_sources"], lambda x: entry(acc, x)))
        return put(acc, s["target"], F.array_distinct(F.concat(s["defined"], inherited)))

    def create(acc: Column, t: Column) -> Column:
        return put(acc, t["table"], F.array_union(entry(acc, t["table"]), t["aliases"]))

    return F.aggregate(creates, F.aggregate(scopes, empty, step), create)


def prepare(programs: DataFrame) -> DataFrame:
    """Programs with their steps, created tables, registry and accounts assigned anywhere."""
    out = C.with_clean(programs)
    out = out.withColumns({
        "scopes": C.step_scopes(F.col("clean")),
        "creates": C.sql_creates(F.col("clean")),
    })
    return out.withColumns({
        "registry": registry(F.col("scopes"), F.col("creates")),
        "all_accounts": F.filter(F.flatten(F.col("scopes")["assigned"]), lambda v: v.rlike(ACCOUNT)),
    })


def registry_table(programs: DataFrame) -> DataFrame:
    """One row per program, dataset and known variable."""
    known = F.transform(
        F.map_entries("registry"),
        lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("dataset"), v.alias("variable"))),
    )
    return C.unnest(prepare(programs), ["program_id"], F.flatten(known))


def _inherited(s: Column) -> Column:
    known = lambda x: F.coalesce(F.try_element_at(F.col("registry"), x), _none())
    return F.flatten(F.transform(s["set_sources"], known))


def _available(s: Column) -> Column:
    return F.concat(s["defined"], _inherited(s))


def _per_step(pick) -> Column:
    """Findings of every step: `pick` gives the offending variables of one step."""
    return F.flatten(
        F.transform(
            "scopes", lambda s: F.transform(pick(s), lambda v: _hit(s["start_line"], v, s["target"]))
        )
    )


def _unassigned(s: Column) -> Column:
    return F.array_except(F.array_except(s["acct_referenced"], s["assigned"]), _inherited(s))


def account_unreachable() -> Column:
    def pick(s):
        lost = F.array_intersect(_unassigned(s), F.col("all_accounts"))
        return F.array_intersect(lost, s["keep_vars"])

    return _per_step(pick)


def account_nowhere() -> Column:
    def pick(s):
        unknown = F.array_except(_unassigned(s), F.col("all_accounts"))
        used = lambda v: F.regexp_like(
            s["body"], F.concat(F.lit(r"(?Uidm)^\s*\w+\s*=.*\b"), v, F.lit(r"\b"))
        )
        return F.filter(unknown, lambda v: F.array_contains(s["keep_vars"], v) | used(v))

    return _per_step(pick)


def keep_undefined() -> Column:
    return _per_step(
        lambda s: F.filter(F.array_except(s["keep_vars"], _available(s)), lambda v: v.rlike(ACCOUNT))
    )


def formula_undefined() -> Column:
    def of_step(s):
        def of_formula(text):
            lhs = F.upper(F.regexp_extract(text, C.PATTERNS["formula"], 1))
            rhs = F.upper(F.regexp_extract(text, C.PATTERNS["formula"], 2))
            lost = F.array_except(F.array_except(C.found(rhs, "account", 0), _available(s)), F.array(lhs))
            return F.transform(lost, lambda v: _hit(s["start_line"], v, lhs))

        return F.flatten(F.transform(C.found(s["body"], "formula", 0), of_formula))

    return F.flatten(F.transform("scopes", of_step))


def self_reimport() -> Column:
    clean = F.col("clean")
    stems = lambda paths: F.transform(
        paths, lambda p: F.struct(path_stem(F.trim(p)).alias("stem"), F.trim(p).alias("path"))
    )
    written = F.filter(stems(C.found(clean, "export_outfile")), lambda w: w["stem"] != "")
    read = stems(F.concat(C.found(clean, "infile_path"), C.found(clean, "import_datafile")))

    def joined(b: Column) -> Column:
        return F.flatten(
            F.transform(
                b["written"],
                lambda w: F.transform(
                    F.filter(b["read"], lambda r: r["stem"] == w["stem"]),
                    lambda r: _hit(F.lit(0), r["path"], w["path"]),
                ),
            )
        )

    return C.let(F.struct(written.alias("written"), read.alias("read")), joined)


def _chains(strict: bool) -> Column:
    """Value-map chains of the watched variable with the end found behind them.

    `outcome` is else, commented or none, whichever shows first after the chain and before the end
    of its step. Strict mode reads comment-free lines, where a commented ELSE cannot be seen.
    """
    maps = F.filter(C.value_maps(F.col("clean")), lambda m: m["src_var"].contains(MAPPED_VARIABLE))
    clean_lines = F.split("clean", "\n")
    raw_lines = clean_lines if strict else F.split("content", "\n")
    read = F.struct(maps.alias("maps"), clean_lines.alias("clean"), raw_lines.alias("raw"))

    def chains(r: Column) -> Column:
        keys = F.transform(r["maps"], lambda m: F.struct(m["src_var"].alias("src"), m["tgt_var"].alias("tgt")))
        return F.transform(F.array_distinct(keys), lambda k: C.let(members(r, k), lambda c: chain(r, c)))

    def members(r: Column, k: Column) -> Column:
        mine = F.filter(r["maps"], lambda m: (m["src_var"] == k["src"]) & (m["tgt_var"] == k["tgt"]))
        return C.let(mine, lambda ms: F.struct(
            k["src"].alias("src"), k["tgt"].alias("tgt"), F.array_min(ms["line"]).alias("first"),
            F.array_max(ms["line"]).alias("last"), F.array_join(C.as_set(ms["src_val"]), ", ").alias("covered"),
        ))

    def chain(r: Column, c: Column) -> Column:
        tail = F.arrays_zip(
            F.slice(r["clean"], c["last"] + 1, F.size(r["clean"])).alias("clean"),
            F.slice(r["raw"], c["last"] + 1, F.size(r["clean"])).alias("raw"),
        )

        def seen(line: Column, i: Column) -> Column:
            word = F.upper(F.regexp_extract(line["clean"], r"(?Ui)^\s*ELSE\s+(\w*)", 1))
            kind = F.when((word != "") & word.startswith(c["tgt"]), "else").when(
                line["raw"].rlike(r"(?Uid)/\*.*ELSE.*\*/"), "commented"
            ).when(line["clean"].rlike(STEP_END), "none")
            return F.struct(kind.alias("kind"), (c["last"] + i + 1).alias("line"))

        hits = F.filter(F.transform(tail, seen), lambda x: x["kind"].isNotNull())
        return C.let(F.get(hits, F.lit(0)), lambda end: F.struct(
            c["src"].alias("src"), c["tgt"].alias("tgt"), c["first"].alias("first"), c["covered"].alias("covered"),
            F.coalesce(end["kind"], F.lit("none")).alias("outcome"), end["line"].alias("end_line"),
        ))

    return C.let(read, chains)


def map_else_commented(strict: bool = False) -> Column:
    hits = F.filter(_chains(strict), lambda c: c["outcome"] == "commented")
    return F.transform(hits, lambda c: _hit(c["end_line"], c["covered"], c["tgt"]))


def map_no_else(strict: bool = False) -> Column:
    hits = F.filter(_chains(strict), lambda c: c["outcome"] == "none")
    return F.transform(hits, lambda c: _hit(c["first"], c["covered"], c["tgt"]))


PROGRAM_RULES = {
    "VARIAVEL_CONTABIL_INDEFINIDA": account_unreachable,
    "VARIAVEL_CONTABIL_INEXISTENTE": account_nowhere,
    "KEEP_VARIAVEL_INDEFINIDA": keep_undefined,
    "FORMULA_REFERENCIA_INDEFINIDA": formula_undefined,
    "AUTO_REIMPORTACAO": self_reimport,
    "MAPEAMENTO_ELSE_COMENTADO": map_else_commented,
    "MAPEAMENTO_SEM_ELSE": map_no_else,
}


def _findings(hits: DataFrame, category: Column | str) -> DataFrame:
    """Rows (filename, line, subject, target) with the fields every finding has."""
    category = F.lit(category) if isinstance(category, str) else category

    def lookup(table: dict) -> Column:
        pairs = [F.lit(x) for item in table.items() for x in item]
        return F.create_map(*pairs)[category]

    text = F.replace(
        F.replace(lookup(MESSAGES), F.lit("{target}"), F.coalesce("target", F.lit(""))),
        F.lit("{subject}"), F.coalesce("subject", F.lit("")),
    )
    return hits.select(
        lookup({k: v[0] for k, v in CATEGORIES.items()}).alias("severity"),
        category.alias("category"), F.col("filename").alias("program"), "line", "subject", "target",
        text.alias("description"),
        lookup({k: v[1] for k, v in CATEGORIES.items()}).alias("recommendation_type"),
        lookup(IMPACTS).alias("impact"), lookup(ADVICE).alias("recommendation"),
    )


def _hits(categories: list[str]) -> Column:
    fields = ["line", "subject", "target"]

    def tagged(category: str) -> Column:
        return F.transform(
            PROGRAM_RULES[category](),
            lambda h: F.struct(F.lit(category).alias("category"), *[h[f].alias(f) for f in fields]),
        )

    return F.concat(*[tagged(c) for c in categories])


def _mapped(section: str) -> Column:
    """Values of the watched variable mapped in a section."""
    return C.as_set(F.filter("watched", lambda m: m["section"] == section)["src_val"])


def _watched(programs: DataFrame) -> DataFrame:
    maps = F.filter(C.value_maps(F.col("content")), lambda m: m["src_var"].contains(MAPPED_VARIABLE))
    return programs.withColumn("watched", maps)


# What a program's row can hold besides its name, and how it is read off the text.
FACTS = {
    "hits": lambda: _hits(list(PROGRAM_RULES)),
    "sections": lambda: C.sections(F.col("content")),
    "accounts": lambda: C.accounts(F.col("content"))["assigned"],
    "types": lambda: C.export_types(F.col("content")),
    "general": lambda: _mapped("geral"),
    "accepted": lambda: _mapped("aceito"),
}


def facts(programs: DataFrame, names: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """One row per program: filename, the named facts (all of them without names) and columns to keep."""
    names = names or list(FACTS)
    df = prepare(programs) if "hits" in names else programs
    df = _watched(df) if {"general", "accepted"} & set(names) else df
    return df.select("filename", *keep, *[FACTS[n]().alias(n) for n in names])


def program_findings(programs: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Findings of the one-program rules."""
    found = _hits(categories or list(PROGRAM_RULES))
    return _findings(C.unnest(prepare(programs), ["filename"], found), F.col("category"))


# --- rules that compare programs ------------------------------------------------------------


def _corpus_row(hits: DataFrame, subject: Column) -> DataFrame:
    return hits.select("filename", F.lit(0).alias("line"), subject.alias("subject"), F.lit(None).cast("string").alias("target"))


def _lacking() -> Column:
    """How many of the known values are missing; reshape.missing_values names them for one program."""
    return F.format_string("%d of %d", "n_missing", "n_known")


def section_missing(known: DataFrame) -> DataFrame:
    """Sections some programs with direct business have and others lack, one row per program that lacks one."""
    kinds = ["accepted", "summary", "reconciliation"]
    flags = known.select("filename", "sections.*").where("direct")
    counts = flags.agg(*[F.sum(F.col(k).cast("int")).alias(k) for k in kinds])
    present = {k: counts.select(k).scalar() for k in kinds}
    lacking = F.array_compact(F.array(*[F.when((present[k] > 0) & ~F.col(k), F.lit(k)) for k in kinds]))
    rows = flags.select("filename", F.explode(lacking).alias("section"))
    return _findings(_corpus_row(rows, F.col("section")), "SECAO_AUSENTE")


def account_coverage(known: DataFrame, at_least: int = 5) -> DataFrame:
    """Accounts that peer programs assign and this one does not."""
    main = known.where(F.col("sections.direct") & (F.size("accounts") >= at_least))
    gaps = coverage_gaps(main.select("filename", F.explode("accounts").alias("account")), "filename", "account")
    return _findings(_corpus_row(gaps, _lacking()), "CONTA_CONTABIL_AUSENTE")


def map_internal(known: DataFrame) -> DataFrame:
    """Values mapped in the general section of a program but not in its accepted section."""
    mapped = known.where((F.size("general") > 0) | (F.size("accepted") > 0))
    several = mapped.agg(F.count(F.lit(1))).scalar() >= 2
    lost = F.array_except("general", "accepted")
    rows = mapped.where(several & (F.size("accepted") > 0) & (F.size(lost) > 0))
    return _findings(_corpus_row(rows, F.array_join(lost, ", ")), "MAPEAMENTO_INCONSISTENTE_INTERNO")


def general_gaps(known: DataFrame) -> DataFrame:
    """How many of the values that any program maps in its general section each program lacks."""
    values = known.select("filename", F.explode("general").alias("value"))
    return coverage_gaps(values, "filename", "value")


def map_divergent(known: DataFrame) -> DataFrame:
    """Values other programs map in their general section and this one does not."""
    return _findings(_corpus_row(general_gaps(known), _lacking()), "MAPEAMENTO_DIVERGENTE_ENTRE_PROGRAMAS")


def export_missing(known: DataFrame) -> DataFrame:
    """Accepted-business files that some main program exports and this one does not; one row per program."""
    main = known.where(F.arrays_overlap("types", C.texts(*MAIN_EXPORTS)))
    seen = main.agg(*[F.max(F.array_contains("types", t)).alias(t) for t in ACCEPTED_EXPORTS])
    exported = {t: seen.select(t).scalar() for t in ACCEPTED_EXPORTS}
    lacking = F.array_compact(
        F.array(*[F.when(exported[t] & ~F.array_contains("types", t), F.lit(t)) for t in ACCEPTED_EXPORTS])
    )
    rows = main.select("filename", lacking.alias("lacking")).where(F.size("lacking") > 0)
    return _findings(_corpus_row(rows, F.array_join("lacking", ", ")), "EXPORT_AUSENTE")


# Rules that compare programs, and the facts each one reads.
CORPUS_RULES = {
    section_missing: ["sections"],
    account_coverage: ["sections", "accounts"],
    map_internal: ["general", "accepted"],
    map_divergent: ["general"],
    export_missing: ["types"],
}


def corpus_findings(programs: DataFrame, rule) -> DataFrame:
    """Findings of one rule that compares programs; only its facts are read off the text, once."""
    return rule(stored(facts(programs, CORPUS_RULES[rule]), "facts"))


def find_in(known: DataFrame) -> DataFrame:
    """Findings of all rules from a table of facts."""
    own = _findings(C.unnest(known, ["filename"], F.col("hits")), F.col("category"))
    return reduce(lambda a, b: a.unionByName(b), [own, *[rule(known) for rule in CORPUS_RULES]])


def find_all(programs: DataFrame) -> DataFrame:
    return find_in(stored(facts(programs), "facts"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Per severity: findings, programs and the sorted categories (a closed list), worst first."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITY_ORDER) for x in (s, i)])
    return (
        findings.groupBy("severity")
        .agg(
            F.count(F.lit(1)).alias("findings"),
            F.count_distinct("program").alias("programs"),
            F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"),
        )
        .orderBy(place[F.col("severity")])
    )
