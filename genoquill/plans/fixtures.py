"""Deterministic relations over the driver's tables, as Spark frames and as SQL common table expressions.

Each relation is a list of (column, expression) in the dialect that Spark and the oracle share; {S} is the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LETTER = "substr('ACGT', CAST(1 + ({0}) % 4 AS INT), 1)"
_ANCHOR = _LETTER.format("l_partkey")

VARIANTS = [
    ("genome_id", "concat('G', CAST(o_custkey % 50 AS {S}))"),
    ("contig_id", "concat('C', CAST(l_suppkey % 5 AS {S}))"),
    ("pos", "l_partkey % 400"),
    ("phase", "CAST(1 + l_linenumber % 2 AS INT)"),
    ("identifier", "CASE WHEN l_partkey % 3 = 0 THEN concat('rs', CAST(l_partkey % 400 AS {S})) ELSE '' END"),
    ("ref", f"CASE WHEN l_partkey % 10 = 7 THEN concat({_ANCHOR}, repeat('G', CAST(1 + l_partkey % 5 AS INT))) ELSE {_ANCHOR} END"),
    ("alt", f"CASE WHEN l_partkey % 10 = 7 THEN {_ANCHOR} WHEN l_partkey % 10 = 8 THEN concat({_ANCHOR}, repeat('T', CAST(1 + l_suppkey % 5 AS INT))) ELSE {_LETTER.format('l_partkey + 1 + l_linenumber % 3')} END"),
    ("pass", "l_returnflag <> 'R'"),
    ("dp", "CAST(l_quantity AS BIGINT)"),
    ("af", "CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_partkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END"),
    ("vqslod", "CASE WHEN l_linestatus = 'O' THEN CAST(round(l_discount * 100) AS DOUBLE) - CAST(5 AS DOUBLE) ELSE NULL END"),
    ("vcf_line", "l_orderkey * 10 + l_linenumber"),
    ("part", "l_partkey"),
    ("supp", "l_suppkey"),
    ("impact", "CASE l_linenumber % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' ELSE 'LOW' END"),
    ("gene", "CASE WHEN l_partkey % 4 = 0 THEN concat('X', CAST(l_partkey % 97 AS {S})) ELSE concat('ENSG', CAST(l_partkey % 97 AS {S})) END"),
]
RELATIONS: dict[str, tuple[list[tuple[str, str]], str]] = {
    "variants": (VARIANTS, "lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "samples": (
        [
            ("genome_id", "concat('G', CAST(c_custkey % 50 AS {S}))"),
            ("fws", "CAST((c_custkey % 50 * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE)"),
            ("qc_pass", "(c_custkey % 50) % 7 <> 0"),
            ("coi", "CAST(1 + (c_custkey % 50) % 3 AS INT)"),
            ("city", "concat('T', CAST((c_custkey % 50) % 11 AS {S}))"),
            ("country", "concat('N', CAST((c_custkey % 50) % 4 AS {S}))"),
            ("population", "concat('P', CAST((c_custkey % 50) % 5 AS {S}))"),
            ("sex", "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END"),
            ("lat", "CAST((c_custkey % 50) % 11 AS DOUBLE) * 3 - 15"),
            ("lon", "CAST((c_custkey % 50) % 11 AS DOUBLE) * 7 - 30"),
        ],
        "(SELECT min(c_custkey) AS c_custkey FROM customer GROUP BY c_custkey % 50) c",
    ),
    "genes": (
        [("gene_id", "concat('g', CAST(p_partkey AS {S}))"), ("contig_id", "concat('C', CAST(p_partkey % 5 AS {S}))"), ("lower", "p_partkey % 400"), ("upper", "p_partkey % 400 + p_size"), ("strand", "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END")],
        "part",
    ),
    "annotations": (
        [("gene", "concat('a', CAST(l_partkey AS {S}))"), ("term", "concat('S', CAST(l_suppkey AS {S}))"), ("evidence", "l_returnflag")],
        "(SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem) l",
    ),
    "term_edges": (
        [("child", "child"), ("parent", "parent")],
        """(SELECT concat('N', CAST(n_nationkey AS {S})) AS child, concat('R', CAST(n_regionkey AS {S})) AS parent FROM nation
            UNION SELECT concat('N', CAST(n_nationkey AS {S})), concat('R', CAST(CAST(floor(n_nationkey / 5) AS INT) % 5 AS {S})) FROM nation
            UNION SELECT concat('R', CAST(r_regionkey AS {S})), 'ROOT' FROM region
            UNION SELECT concat('S', CAST(s_suppkey AS {S})), concat('N', CAST(s_nationkey AS {S})) FROM supplier) e""",
    ),
    "publications": (
        [
            ("pmid", "doc_id"),
            ("year", "CAST(1990 + doc_id % 30 AS INT)"),
            ("month", "CAST(1 + doc_id % 12 AS INT)"),
            ("journal", "source"),
            ("author", "concat('Au, ', CAST(doc_id % 37 AS {S}))"),
            ("initials", "substr('jkl', CAST(1 + doc_id % 3 AS INT), 1)"),
            ("title", "text"),
            ("abstract", "text"),
            ("chemical", "concat('ch', CAST(doc_id % 13 AS {S}))"),
            ("mesh", "concat('D', CAST(doc_id % 17 AS {S}))"),
        ],
        "documents",
    ),
    "citations": ([("pmid", "doc_id"), ("cited_by", "(doc_id * 7 + i) % n")], "documents, (SELECT count(*) AS n FROM documents) t, (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 5) k"),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of RELATIONS over the Parquet tables of sf_dir."""
    columns, source = RELATIONS[name]
    sql = f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns)} FROM {source}".replace("{S}", "STRING")
    for t in ("lineitem", "orders", "customer", "part", "nation", "region", "supplier", "documents"):
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`").replace(f"JOIN {t} ", f"JOIN parquet.`{sf_dir}/{t}.parquet` ")
    return spark.sql(sql)


def ctes(*names: str) -> str:
    """WITH clause that defines the relations for the oracle; more expressions may follow behind a comma."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in RELATIONS[n][0])} FROM {RELATIONS[n][1]})".replace("{S}", "VARCHAR") for n in names)


#: Texts of variant expressions for the oracle.
HGVS = "concat(contig_id, ':g.', CAST(pos AS VARCHAR), ref, '>', alt)"
KIND = "CASE WHEN length(ref) = length(alt) THEN 'SNP' WHEN length(ref) < length(alt) THEN 'INSERT' ELSE 'DELETE' END"
SNP = "(length(ref) = length(alt))"
