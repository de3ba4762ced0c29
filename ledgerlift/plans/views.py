"""Stand-in inputs derived from the base tables.

Every view is one SELECT that Spark and a reference SQL engine both read, with base
tables and earlier views in braces. `view` builds it on Spark; `with_views` renders the
same text as a WITH prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

REF_DATE = "1998-06-30"

VIEWS: dict[str, str] = {}

VIEWS["installments"] = """
SELECT 199806 AS ano_mes,
  CASE WHEN l.l_suppkey % 2 = 0 THEN 6238 ELSE 5665 END AS cod_seguradora,
  l.l_orderkey AS cod_apolice,
  l.l_linenumber AS num_parcela,
  CASE WHEN l.l_linenumber = 7 THEN 0 ELSE 7 END AS qtde_parcelas,
  CASE WHEN l.l_linestatus = 'O' THEN 'D' ELSE 'A' END AS cod_tp_emissao,
  c.c_mktsegment AS cod_sistema_origem,
  l.l_partkey AS cod_produto,
  p.p_size % 10 AS grupo_ramo,
  p.p_size AS cod_ramo,
  l.l_suppkey AS cod_agencia,
  CASE WHEN p.p_size % 4 = 0 THEN 220 ELSE 790 END AS cod_moeda,
  CASE WHEN o.o_custkey % 97 = 0 THEN NULL ELSE o.o_custkey END AS cpf_cnpj,
  CAST(o.o_orderdate AS DATE) AS dt_inicio,
  CAST(CAST(o.o_orderdate AS DATE) + INTERVAL '365' DAY AS DATE) AS dt_fim,
  CASE WHEN l.l_quantity = 13 THEN NULL ELSE CAST(l.l_shipdate AS DATE) END AS dt_vencimento,
  l.l_extendedprice AS val_cobranca,
  l.l_extendedprice * l.l_tax AS val_iof,
  l.l_extendedprice * l.l_discount AS val_comissao,
  CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity ELSE 0 END AS val_estipulante,
  CASE WHEN l.l_returnflag = 'N' THEN l.l_quantity * 2 ELSE 0 END AS val_cosseguro,
  CASE WHEN l.l_returnflag = 'A' THEN l.l_quantity * 3 ELSE 0 END AS val_comissao_cosseguro
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {part} p ON l.l_partkey = p.p_partkey
"""

VIEWS["reinsurance_pct"] = """
SELECT DISTINCT p_size AS cod_ramo, CASE WHEN p_partkey % 3 = 0 THEN -p_partkey ELSE p_partkey END AS cod_produto,
  CAST(p_partkey % 5 AS DOUBLE) / 10 AS percentual_sas
FROM {part}
"""

VIEWS["calc_group"] = """
SELECT DISTINCT p_size % 10 AS grupo_ramo, CASE WHEN p_size = 50 THEN 1050 ELSE p_size END AS cod_ramo,
  concat('G', CAST(p_size % 4 AS VARCHAR(10))) AS grupo_calculo
FROM {part}
"""

VIEWS["factors"] = """
SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 6238 ELSE 5665 END AS cod_seguradora,
  CASE WHEN l_linestatus = 'O' THEN 'D' ELSE 'A' END AS cod_tp_emissao,
  CASE WHEN l_orderkey % 2 = 0 THEN 'DECORRER' ELSE 'DECORRIDO' END AS status_vigencia,
  CASE WHEN l_orderkey % 4 < 2 THEN 'ADIMPLENTE' ELSE 'INADIMPLENTE' END AS status_cliente,
  CASE WHEN l_orderkey % 8 < 4 THEN 'ADIMPLENTE' ELSE 'INADIMPLENTE' END AS status_apolice,
  CASE WHEN l_orderkey % 16 < 8 THEN 'ADIMPLENTE' ELSE 'INADIMPLENTE' END AS status_parcela,
  l_linenumber * 2 - 3 AS agging_meses,
  CASE WHEN l_orderkey % 32 < 16 THEN 'vcto apolice' ELSE 'vcto parcela' END AS ref_agging,
  CASE l_partkey % 6 WHEN 4 THEN 'Pessoas' WHEN 5 THEN 'Localiza'
       ELSE concat('G', CAST(l_partkey % 6 AS VARCHAR(10))) END AS grupo_calculo,
  CASE WHEN l_linenumber = 4 THEN NULL
       ELSE CAST((l_linenumber * 2 - 3) * 7 + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) / 50 - 0.1E0 END AS fator
FROM {lineitem}
"""

VIEWS["customers_raw"] = """
SELECT o.o_custkey AS customer_id, c.c_name AS customer_name, c.c_mktsegment AS segment,
  c.c_acctbal AS income, CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE o.o_orderstatus END AS status,
  o.o_orderkey AS load_seq, o.o_totalprice AS risk_score
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

VIEWS["addresses"] = """
SELECT CASE WHEN c.c_custkey % 4 = 0 THEN -c.c_custkey ELSE c.c_custkey END AS customer_id, n.n_name AS city, r.r_name AS state
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["policies"] = """
SELECT o_orderkey AS policy_id, o_custkey AS customer_id, o_orderkey % 120 AS product_code,
  o_totalprice AS premium_amount, CAST(o_orderdate AS DATE) AS start_date, o_orderstatus AS status
FROM {orders}
"""

VIEWS["products"] = """
SELECT DISTINCT p_size AS product_code, concat('Product ', CAST(p_size AS VARCHAR(10))) AS product_name,
  concat('Cat ', CAST(p_size % 7 AS VARCHAR(10))) AS category
FROM {part}
"""

VIEWS["claims"] = """
SELECT event_id AS claim_id, user_id * 7 AS policy_id, event_type AS claim_type, value AS claim_amount,
  CASE WHEN event_id % 3 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status
FROM {events}
"""

# A corpus of program text: one program per part, so it grows with the scale factor.
# Fixed kinds of text, chosen by part key, bring in every fact the extraction looks for.
VIEWS["programs"] = """
SELECT p_partkey AS program_id,
  concat('prog_', CAST(p_partkey AS VARCHAR(20)), '.sas') AS filename,
  concat(
    'LIBNAME raw ''/d/raw'';', chr(10),
    CASE WHEN p_partkey % 10 = 1 THEN concat('LIBNAME dw "/d/dw";', chr(10)) ELSE '' END,
    '/* load from stage', chr(10), '   second line */', chr(10),
    CASE WHEN p_partkey % 4 = 0 THEN concat('%MACRO m', CAST(p_size AS VARCHAR(10)), '(x);', chr(10), '%MEND;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 6 = 0 THEN concat('%M', CAST((p_size + 1) % 50 AS VARCHAR(10)), '(1); %put(x);', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 25 = 3 THEN concat('%INCLUDE ''/inc/i', CAST(p_size AS VARCHAR(10)), '.sas'';', chr(10)) ELSE '' END,
    '%LET ref = ', CAST(p_size AS VARCHAR(10)), ';', chr(10),
    CASE WHEN p_partkey % 12 = 5 THEN concat('FILENAME inz ZIP "/z/a.zip"; FILENAME oth "/z/b.txt";', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 20 = 7 THEN concat('* old step with merge x y;', chr(10)) ELSE '' END,
    'PROC SORT DATA=raw.t', CAST(p_size AS VARCHAR(10)), ' OUT=work.s NODUPKEY; BY id; RUN;', chr(10),
    CASE WHEN p_partkey % 11 = 2 THEN concat('PROC SQL; CREATE TABLE work.q AS SELECT a.id AS qid, b.v AS qv FROM raw.a a LEFT JOIN raw.b b ON a.id = b.id INNER JOIN raw.c c ON a.id = c.id; QUIT;', chr(10)) ELSE '' END,
    'DATA work.o', CAST(p_partkey AS VARCHAR(20)),
    CASE WHEN p_partkey % 13 = 4 THEN ' (keep=id total)' ELSE '' END, ';', chr(10),
    CASE WHEN p_partkey % 3 = 0 THEN '  MERGE work.s (IN=a) raw.addr (IN=b); BY id; IF a;'
         ELSE concat('  SET work.o', CAST(CASE WHEN p_partkey >= 7 THEN p_partkey - 7 ELSE 0 END AS VARCHAR(20)), ';') END, chr(10),
    CASE WHEN p_partkey % 14 = 6 THEN concat('  LENGTH total 8 nome $20;', chr(10), '  FORMAT dt_ref DDMMYY10. val COMMAX20.2;', chr(10), '  DROP tmp1 tmp2;', chr(10)) ELSE '' END,
    '  C1131900000 = val * 2;', chr(10),
    CASE WHEN p_partkey % 2 = 0 THEN concat('  C1212190000 = C1131900000 + C2125190000;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 8 = 1 THEN concat('  C2122290000 = 1;', chr(10), '  C2123190000 = 2;', chr(10), '  C2123390000 = 3;', chr(10),
         CASE WHEN p_partkey % 16 = 1 THEN '  C2123590000 = 4;' ELSE '  C1132900002 = 5;' END, chr(10),
         CASE WHEN p_partkey % 24 = 1 THEN '  C2128900000 = 6;' ELSE '' END, chr(10),
         CASE WHEN p_partkey % 24 = 9 THEN '  C2128900009 = 7;' ELSE '' END, chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 8 <= 3 THEN concat('  IF cod_tp_emissao = "D" THEN out = 1;', chr(10)) ELSE '' END,
    '  IF cod_sistema_origem = "SYS', CAST(p_partkey % 6 AS VARCHAR(10)), '" THEN letra = "L";', chr(10),
    CASE WHEN p_partkey % 5 = 1 THEN concat('  ELSE IF cod_sistema_origem = "SYS9" THEN letra = "M";', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 5 = 0 THEN concat('  ELSE letra = "Z";', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 5 = 3 THEN concat('  /* ELSE letra = "Z"; */', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 9 = 0 THEN concat('  DECLARE HASH h(dataset: "raw.x");', chr(10)) ELSE '' END,
    '  KEEP id C1131900000 C3152710000;', chr(10), 'RUN;', chr(10),
    CASE WHEN p_partkey % 10 = 4 THEN concat('DATA work.z; SET work.o', CAST(p_partkey AS VARCHAR(20)), ';', chr(10), '  KEEP C1131900000 C1212190000;', chr(10), 'RUN;', chr(10),
         'DATA work.y;', chr(10), '  SET raw.none;', chr(10), '  C9999999999 = C1131900000;', chr(10), '  KEEP C1131900000;', chr(10), 'RUN;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 7 = 2 THEN concat('/* bloco aceito */', chr(10), 'DATA work.ac; SET work.s; IF cod_tp_emissao = "A" THEN out = 2;', chr(10),
         '  IF cod_sistema_origem = "SYS2" THEN letra_ac = "L";', chr(10), 'RUN;', chr(10)) ELSE '' END,
    CASE p_type WHEN 'PROMO' THEN concat('PROC LOGISTIC DATA=work.s; RUN;', chr(10))
                WHEN 'SMALL' THEN concat('PROC FREQ DATA=work.s; RUN;', chr(10))
                WHEN 'LARGE' THEN concat('PROC MEANS DATA=work.s; RUN;', chr(10))
                WHEN 'MEDIUM' THEN concat('PROC TABULATE DATA=work.s; RUN; PROC FORMAT; RUN; PROC IML; RUN;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 8 = 0 THEN concat('CALL EXECUTE("x");', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 15 = 8 THEN concat('x = "Status Vigencia"n; y = "', chr(92), chr(92), 'host', chr(92), 'share', chr(92), 'f.txt";', chr(10)) ELSE '' END,
    CASE WHEN p_size % 2 = 0 THEN concat('PROC EXPORT DATA=work.s OUTFILE="/out/', CAST(p_size AS VARCHAR(10)), '_sap_direto.csv" DBMS=CSV replace; RUN;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 9 = 4 THEN concat('PROC EXPORT DATA=work.s OUTFILE="/out/sap_aceito.csv" DBMS=XLSX replace; RUN;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 18 = 5 THEN concat('PROC EXPORT DATA=work.s OUTFILE="/out/conciliacao_', CAST(p_size AS VARCHAR(10)), '.csv" DBMS=XLSX replace; RUN;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 10 = 6 THEN concat('PROC IMPORT DATAFILE="/in/', CAST(p_size AS VARCHAR(10)), '_sap_direto.csv" OUT=work.imp DBMS=DLM replace; RUN;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 22 = 9 THEN concat('DATA work.rd; INFILE "/in/sap_aceito.txt"; INPUT a; RUN;', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 16 <= 1 THEN concat('/* Conciliação */', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 21 <= 4 THEN concat('DATA work.resumo_aging; SET work.s; RUN;', chr(10)) ELSE '' END
  ) AS content
FROM {part}
"""

VIEWS["lineage_input"] = """
SELECT concat('o', CAST(o_orderkey AS VARCHAR(20)), '.sas') AS filename,
  concat('raw.c', CAST(o_custkey AS VARCHAR(20))) AS ds_read,
  CASE WHEN o_custkey % 10 <> 9 THEN concat('raw.c', CAST(o_custkey + 1 AS VARCHAR(20)))
       WHEN o_custkey % 50 = 9 THEN concat('raw.c', CAST(o_custkey - 9 AS VARCHAR(20)))
       ELSE concat('DW.out', CAST(o_custkey AS VARCHAR(20))) END AS ds_written
FROM {orders}
"""

# Column metadata: eight columns per dataset, one per part.
VIEWS["columns_meta"] = """
SELECT concat(CASE p_partkey % 72 - p_partkey % 8 WHEN 0 THEN 'customer_base_' WHEN 8 THEN 'payments_'
         WHEN 16 THEN 'lookup_codes_' WHEN 24 THEN 'claims_' WHEN 32 THEN 'pendente_analitico_'
         WHEN 40 THEN 'policy_dim_' WHEN 48 THEN 'risk_model_' WHEN 56 THEN 'mystery_'
         ELSE 'produto_' END, CAST((p_partkey - p_partkey % 8) AS VARCHAR(20))) AS dataset_name,
  CAST(p_partkey % 8 AS INT) AS position,
  concat(CASE p_partkey % 37 WHEN 0 THEN 'cpf' WHEN 1 THEN 'Email_Contato' WHEN 2 THEN 'NOME_produto'
         WHEN 3 THEN 'phone' WHEN 5 THEN 'score' WHEN 7 THEN 'premium_amount' WHEN 11 THEN 'cargo'
         WHEN 13 THEN 'item_no' ELSE 'val' END,
         CASE WHEN p_partkey % 37 IN (0, 3) THEN '' ELSE concat('_', CAST(p_partkey % 8 AS VARCHAR(4))) END) AS name,
  CASE WHEN p_partkey % 5 = 4 THEN 'char' WHEN p_partkey % 41 = 0 THEN 'unknown' ELSE 'num' END AS type,
  p_size AS length,
  CASE p_partkey % 11 WHEN 0 THEN 'DDMMYY10.' WHEN 1 THEN 'COMMAX20.2' WHEN 2 THEN 'COMMAX20.18'
         WHEN 3 THEN 'DATETIME20.' WHEN 4 THEN 'E8601DT.' WHEN 5 THEN 'BEST14.' WHEN 6 THEN 'DATE9.'
         WHEN 7 THEN 'DOLLAR12.2' WHEN 8 THEN '' WHEN 9 THEN 'YYMMDD10.' ELSE '$CHAR10.' END AS format,
  p_name AS label
FROM {part}
"""

VIEWS["datasets_meta"] = """
SELECT dataset_name, CASE WHEN max(length) > 47 THEN -1 ELSE sum(length) END AS row_count,
  count(*) AS column_count
FROM {columns_meta} GROUP BY dataset_name
"""

# Declared schemas: reading needs no inference job.
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
BASE_TABLES = list(BASE_SCHEMAS)


# Views whose rows cost far more to work on than to move, and the key that deals them out evenly.
DEALT = {"programs": "program_id"}


# Inner joins in the order Spark runs them, where that of the text would shuffle the longest table more often: customers
# meet their orders first, and line items their orders last, so the rows end up dealt out by order.
JOIN_ORDER = {"installments": """FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN ({orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey) ON l.l_orderkey = o.o_orderkey
"""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def refs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    if name in JOIN_ORDER:
        sql = sql[:sql.rindex("FROM ")] + JOIN_ORDER[name]
    df = spark.sql(sql, **{r: view(spark, sf_dir, r) for r in refs(sql)})
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), DEALT[name]) if name in DEALT else df


def with_views(names: str, body: str) -> str:
    """`body` behind a WITH prefix holding the named views and the views they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in ordered:
            return
        for r in refs(VIEWS[name]):
            visit(r)
        ordered.append(name)

    for n in names.split():
        visit(n)
    ctes = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n]).strip()})" for n in ordered]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):].strip()
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
