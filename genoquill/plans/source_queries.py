"""Queries that write the relations in a format and read them back: what a reader gives is what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features as R
from ..operators import joins as J
from ..operators import ontology as G
from ..sources import formats as S
from ..sources import sinks
from ..storage import shared_dir
from .fixtures import ctes, frame
from .registry import query
from .sequence_queries import SEQ, sequences

VAR = ctes("variants")


def place(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df, column, tag: str, head: str | None = None, **options) -> str:
    """The path of a folder of text with a line per row; head is a file of its own in front."""
    spark, path = df.sparkSession, place(df.sparkSession, tag)
    if head is not None:
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(path)
    df.select(column.alias("value")).write.mode("append").options(**options).text(path)
    return path


_RECORD = "concat_ws('\t', contig_id, cast(pos + 1 as string), if(identifier = '', '.', identifier), ref, alt, cast(dp as string), if(pass, 'PASS', 'q10'), concat('DP=', dp, if(af is null, '', concat(';AF=', af)), if(supp % 2 = 0, ';DB', '')), 'GT:AD:DP:GQ', {0})"
_GENOTYPES = "concat_ws('\t', concat(if(supp % 3 = 0, '0|1', '1|1'), ':', dp % 7, ',', dp % 5, ':', dp, ':', supp % 50), concat(if(part % 2 = 0, '1|0', '0|0'), ':', part % 3, ',0:', dp, ':9'))"
_HEAD = '##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">\n##INFO=<ID=AF,Number=A,Type=Float,Description="share, of all">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="known">\n##contig=<ID=C0,length=400>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS0\tS1'


def vcf(spark, d) -> str:
    return written(frame(spark, d, "variants"), F.expr(_RECORD.format(_GENOTYPES)), "vcf", _HEAD)


def header(spark) -> dict:
    """The header read from a file that begins with it; the files of a folder have no order."""
    lines = spark.createDataFrame([(f"{_HEAD}\nC0\t1\t.\tA\tC\t.\tPASS\tDP=1\n##INFO=<ID=LATE,Number=1,Type=Float>",)], "value string")
    return S.vcf_header(spark, written(lines.coalesce(1), F.col("value"), "header"))


@query(f"{VAR} SELECT contig_id, pos, identifier, ref, alt, CAST(dp AS DOUBLE) AS qual, pass, dp, af, supp % 2 = 0 AS db FROM variants")
def vcf_round_trip(spark, d):
    path = vcf(spark, d)
    t = S.typed_info(S.vcf_records(spark, path), header(spark)["info"], ["DP", "AF", "DB"])
    return t.select("contig_id", "pos", "identifier", "ref", "alt", "qual", "pass", F.col("DP").alias("dp"), F.get("AF", F.lit(0)).alias("af"), F.col("DB").alias("db"))


_CALLS = """calls AS (SELECT 'S0' AS genome_id, contig_id, pos, ref, alt, dp, supp, 0 AS first, dp % 7 AS rc, dp % 5 AS ac, phase FROM variants v, (VALUES (1), (2)) p(phase) WHERE phase = 2 OR supp % 3 <> 0
UNION ALL SELECT 'S1', contig_id, pos, ref, alt, dp, supp, 0, part % 3, 0, 1 FROM variants WHERE part % 2 = 0)""".replace("variants v, (VALUES (1), (2)) p(phase)", "(SELECT contig_id, pos, ref, alt, dp, supp, part FROM variants) v, (VALUES (1), (2)) p(phase)")


@query(f"{VAR}, {_CALLS} SELECT genome_id, contig_id, pos, ref, alt, phase FROM calls")
def vcf_genotypes(spark, d):
    path = vcf(spark, d)
    t = S.genotype_variants(S.vcf_records(spark, path), header(spark)["samples"])
    return t.select("genome_id", "contig_id", "pos", "ref", "alt", "phase")


@query(f"{VAR}, {_CALLS} SELECT genome_id, contig_id, count(*) AS n, CAST(sum(rc) AS BIGINT) AS reference_reads, CAST(sum(ac) AS BIGINT) AS alternate_reads, CAST(sum(dp) AS BIGINT) AS depth FROM calls WHERE rc + ac > 0 GROUP BY 1, 2")
def vcf_falciparum(spark, d):
    path = vcf(spark, d)
    t = S.falciparum(S.vcf_records(spark, path), ["S0", "S1"])
    return t.groupBy("genome_id", "contig_id").agg(F.count("*").alias("n"), F.sum("ref_count").alias("reference_reads"), F.sum("alt_count_reads").alias("alternate_reads"), F.sum("dp").alias("depth"))


@query(f"{VAR} SELECT 'ref' AS genome_id, contig_id, pos, ref, alt, 255 AS phase FROM variants")
def vcf_single_genome(spark, d):
    return S.single_genome(S.vcf_records(spark, vcf(spark, d)), "ref").select("genome_id", "contig_id", "pos", "ref", "alt", "phase")


@query(f"{SEQ} SELECT concat('d', CAST(doc_id AS VARCHAR)) AS contig_id, 'letters of a text' AS description, s AS sequence FROM seqs WHERE s <> ''")
def fasta_round_trip(spark, d):
    t = sequences(spark, d).where("s <> ''").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("contig_id"), F.lit("letters of a text").alias("description"), F.col("s").alias("sequence"))
    path = place(spark, "fasta")
    S.write_fasta(t, path)
    return S.fasta(spark, path)


@query(f"{ctes('variants')}, {SEQ.removeprefix('WITH ')}, c AS (SELECT concat('C', CAST(doc_id AS VARCHAR)) AS contig_id, s FROM seqs WHERE doc_id < 5) SELECT contig_id, count(*) AS total, count(CASE WHEN substr(s, CAST(pos + 1 AS INT), CAST(length(ref) AS INT)) = ref THEN 1 END) AS valid FROM variants LEFT JOIN c USING (contig_id) GROUP BY 1")
def reference_check(spark, d):
    contigs = sequences(spark, d).where("doc_id < 5").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("contig_id"), F.col("s").alias("sequence"))
    return J.reference_check(frame(spark, d, "variants"), contigs, size=64)


_FEATURES = """concat(contig_id, '\t.\tgene\t', lower + 1, '\t', upper, '\t.\t', strand, '\t.\tID=', gene_id, ';description=some gene\n',
 contig_id, '\t.\tmRNA\t', lower + 1, '\t', upper, '\t.\t', strand, '\t.\tID=', gene_id, '.1;Parent=', gene_id, '\n', contig_id, '\t.\tCDS\t', lower + 1, '\t', upper, '\t.\t', strand, '\t', lower % 3, '\tParent=', gene_id, '.1')"""


def gff(spark, d):
    return S.gff3(spark, written(frame(spark, d, "genes"), F.expr(_FEATURES), "gff", "##gff-version 3"))


@query(ctes("genes") + ", k AS (SELECT 'GENE' AS type UNION ALL SELECT 'MRNA' UNION ALL SELECT 'CDS') SELECT contig_id, type, CASE type WHEN 'GENE' THEN gene_id WHEN 'MRNA' THEN concat(gene_id, '.1') ELSE concat('CDS', CAST(lower AS VARCHAR)) END AS feature_id, lower, upper, strand, CASE type WHEN 'GENE' THEN '' WHEN 'MRNA' THEN gene_id ELSE concat(gene_id, '.1') END AS parent FROM genes, k WHERE upper > lower")
def gff_round_trip(spark, d):
    return gff(spark, d).select("contig_id", "type", "feature_id", "lower", "upper", "strand", F.get("parents", F.lit(0)).alias("parent"))


@query(ctes("genes") + " SELECT contig_id, concat(gene_id, '.1') AS child, gene_id AS parent FROM genes WHERE upper > lower")
def feature_hierarchy(spark, d):
    return R.hierarchy(gff(spark, d).where("type = 'MRNA' OR type = 'GENE'"))


@query(ctes("genes") + " SELECT contig_id, gene_id, concat(gene_id, '.1') AS transcript, strand, 'PROTEIN' AS kind, lower, upper, upper - lower AS coding_length FROM genes WHERE upper > lower")
def gene_transcripts(spark, d):
    f = gff(spark, d).where("type <> 'CDS'").unionByName(gff(spark, d).where("type = 'CDS'").withColumn("feature_id", F.concat(F.lit("c"), F.get("parents", F.lit(0)))))
    t = R.bounds(R.transcripts(f, R.hierarchy(f)))
    return t.select("contig_id", "gene_id", "transcript", "strand", "kind", F.col("start").alias("lower"), F.col("end").alias("upper"), "coding_length")


@query(ctes("annotations") + " SELECT gene, term, evidence FROM annotations")
def gaf_round_trip(spark, d):
    line = "concat_ws('\t', 'DB', gene, 's', '', term, 'ref', evidence, '', 'P', '', '', 'protein', 'taxon:1', '2020', 'x', '', '')"
    bad = "concat_ws('\t', 'DB', gene, 's', '', term, 'ref', evidence, '', 'Z', '', '', 'protein', 'taxon:1', '2020', 'x', '', '')"
    a = frame(spark, d, "annotations")
    return S.gaf(spark, written(a, F.explode(F.array(F.expr(line), F.expr(bad))), "gaf", "!gaf-version: 2.1")).select("gene", "term", "evidence")


_TERM = "concat('[Term]\nid: ', child, '\nname: term ', child, '\nnamespace: biological_process\n', lines, '\n')"


def obo(spark, d):
    e = frame(spark, d, "term_edges").withColumn("l", F.when(F.col("parent").startswith("R"), F.concat(F.lit("relationship: part_of "), "parent", F.lit(" ! x"))).otherwise(F.concat(F.lit("is_a: "), "parent", F.lit(" ! x"))))
    t = e.groupBy("child").agg(F.array_join(F.sort_array(F.collect_list("l")), "\n").alias("lines"))
    root = spark.createDataFrame([("ROOT", "comment: none")], "child string, lines string")
    return S.obo(spark, written(t.union(root), F.expr(_TERM), "obo"))


@query(ctes("term_edges") + " SELECT child, parent, CASE WHEN parent LIKE 'R%' AND parent <> 'ROOT' THEN 'part_of' WHEN parent = 'ROOT' THEN 'part_of' ELSE 'is_a' END AS relation FROM term_edges")
def obo_edges(spark, d):
    return obo(spark, d)[1]


@query(ctes("term_edges") + " SELECT term, concat('term ', term) AS name FROM (SELECT child AS term FROM term_edges UNION SELECT parent FROM term_edges)")
def obo_terms(spark, d):
    return obo(spark, d)[0].select("term", "name")


@query(ctes("term_edges", "annotations") + " SELECT count(DISTINCT child) + 1 AS terms, count(*) AS edges, 1::BIGINT AS roots, 0::BIGINT AS falling FROM term_edges")
def ontology_self_test(spark, d):
    from ..operators import analysis as X

    e = obo(spark, d)[1].select("child", "parent")
    c = G.closure(e)
    return X.ontology_check(e, c, G.information_content(c, frame(spark, d, "annotations"), e)).select("terms", "edges", "roots", "falling")


@query(ctes("citations") + " SELECT DISTINCT concat('rs', CAST(pmid AS VARCHAR)) AS rsid, cited_by AS pmid FROM citations")
def citations_json(spark, d):
    t = frame(spark, d, "citations").groupBy("pmid").agg(F.collect_list("cited_by").alias("c"))
    return S.citations_json(spark, written(t, F.to_json(F.struct(F.col("pmid").cast("string").alias("refsnp_id"), F.col("c").alias("citations"))), "json"))


@query(ctes("citations") + " SELECT DISTINCT concat('rs', CAST(pmid AS VARCHAR)) AS rsid, CAST(cited_by AS VARCHAR) AS pmid FROM citations")
def allele_citations(spark, d):
    path = place(spark, "alleles")
    sinks.append_citations(frame(spark, d, "citations").select(F.concat(F.lit("rs"), F.col("pmid").cast("string")).alias("rsid"), F.col("cited_by").alias("pmid")), path)
    return S.allele_citations(spark, path).where("rsid <> 'rsid'")


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 3 = 0 THEN 'Disease' ELSE 'Gene' END AS type, concat('M', CAST(doc_id % 11 AS VARCHAR)) AS concept_id FROM documents WHERE doc_id % 3 < 2")
def bio_concepts(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    line = "concat_ws('\t', doc_id, case doc_id % 3 when 0 then 'Disease' when 1 then 'Gene' else 'Species' end, concat('M', doc_id % 11), 'text', 'source')"
    return S.bio_concepts(spark, written(t, F.expr(line), "concepts")).select("pmid", "type", "concept_id")


@query(ctes("samples") + " SELECT genome_id, qc_pass, country FROM samples")
def pf7_samples(spark, d):
    t = frame(spark, d, "samples").select(F.col("genome_id").alias("Sample"), F.col("country").alias("country"), F.when(F.col("qc_pass"), "True").otherwise("False").alias("QC pass"))
    path = place(spark, "samples")
    sinks.report(t.coalesce(1), path, "\t")
    return S.pf7_samples(spark, path).select("genome_id", "qc_pass", "country")


@query(ctes("samples") + " SELECT genome_id, CASE WHEN fws >= 0.1 THEN fws END AS fws FROM samples")
def pf7_fws(spark, d):
    path = place(spark, "fws")
    sinks.report(frame(spark, d, "samples").select(F.col("genome_id").alias("Sample"), F.when(F.col("fws") >= 0.1, F.col("fws").cast("string")).otherwise("-").alias("Fws")), path, "\t")
    return S.pf7_fws(spark, path)


@query(ctes("samples") + " SELECT genome_id, CAST(coi AS VARCHAR) AS coi FROM samples")
def complexity_of_infection(spark, d):
    path = place(spark, "coi")
    sinks.report(frame(spark, d, "samples").select(F.col("genome_id").alias("Sample"), "coi"), path, "\t")
    return S.coi(spark, path).select("genome_id", "coi")


@query("SELECT CAST(a.vec_id AS VARCHAR) AS i, CAST(b.vec_id AS VARCHAR) AS j, CASE WHEN a.vec_id <> b.vec_id THEN abs(a.vec_id - b.vec_id) / 4.0::DOUBLE END AS d FROM embeddings a, embeddings b WHERE a.vec_id < 60 AND b.vec_id < 60")
def pf7_distances(spark, d):
    """A matrix of 60 samples, the size being a parameter of the file."""
    names = [str(i) for i in range(60)]
    rows = [("nan" if i == j else str(abs(i - j) / 4.0),) for i in range(60) for j in range(60)]
    path = written(spark.createDataFrame(rows, "value string").coalesce(1), F.col("value"), "distances")
    return S.pf7_distances(spark, path, names)


@query("SELECT concat('H', CAST(p_partkey % 300 AS VARCHAR)) AS hgnc, string_agg(concat('E', CAST(p_partkey AS VARCHAR)), '|' ORDER BY p_partkey % 5 <> 0, concat('E', CAST(p_partkey AS VARCHAR))) AS ensembl_ids FROM part GROUP BY 1")
def ensembl_hgnc(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    path = written(t, F.expr("concat_ws('\t', concat('E', p_partkey), if(p_partkey % 5 = 0, '1', '0'), concat('H', p_partkey % 300))"), "hgnc")
    return S.ensembl_hgnc(spark, path).withColumn("ensembl_ids", F.array_join("ensembl_ids", "|"))


@query("SELECT concat('P', CAST(p_partkey % 200 AS VARCHAR)) AS accession, string_agg(DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_brand END, '|' ORDER BY CASE WHEN p_partkey % 2 = 0 THEN p_brand END) AS gene, string_agg(DISTINCT CASE WHEN p_partkey % 2 = 1 THEN p_type END, '|' ORDER BY CASE WHEN p_partkey % 2 = 1 THEN p_type END) AS kind FROM part GROUP BY 1")
def uniprot_fields(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    path = written(t, F.expr("concat_ws('\t', concat('P', p_partkey % 200), if(p_partkey % 2 = 0, 'Gene', 'Kind'), if(p_partkey % 2 = 0, p_brand, p_type))"), "uniprot")
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    return S.uniprot(spark, path, ["Gene", "Kind"]).select("accession", joined(F.col("Gene")).alias("gene"), joined(F.col("Kind")).alias("kind"))


@query(ctes("samples") + " SELECT genome_id AS individual, country AS family, sex, population FROM samples")
def genealogy_round_trip(spark, d):
    path = written(frame(spark, d, "samples"), F.expr("concat_ws('\t', country, genome_id, 'f', 'm', sex, '0', population, 'child')"), "ped")
    return S.genealogy(spark, path).select("individual", "family", "sex", "population")


@query(ctes("samples") + " SELECT genome_id AS individual, sex, population, country AS super_population FROM samples")
def people_round_trip(spark, d):
    path = written(frame(spark, d, "samples"), F.expr("concat_ws('\t', genome_id, sex, population, 'text', country, 'more')"), "people")
    return S.people(spark, path).select("individual", "sex", "population", "super_population")


@query("SELECT CAST(p_partkey AS VARCHAR) AS entrez, p_name AS symbol, p_type AS type FROM part")
def entrez_genes(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    path = written(t, F.expr("concat_ws('\t', '9606', p_partkey, p_name, '-', '-', '-', '1', '-', 'text', p_type, '-', '-', '-', '-', '2020', '-')"), "entrez", "#tax_id")
    return S.entrez(spark, path).select("entrez", "symbol", "type")


@query("SELECT concat('T', CAST(a.vec_id AS VARCHAR)) AS a, concat('T', CAST(b.vec_id AS VARCHAR)) AS b, CASE WHEN abs(a.vec_id - b.vec_id) < 3 THEN 1.0::DOUBLE / (1 + abs(a.vec_id - b.vec_id)) ELSE 0 END AS s FROM embeddings a, embeddings b WHERE a.vec_id < 30 AND b.vec_id < 30")
def similarity_file(spark, d):
    """A matrix of 30 terms, the size being a parameter of the file, written and read."""
    i = spark.range(30).select(F.col("id").alias("i"))
    m = i.join(i.withColumnRenamed("i", "j"), F.abs(F.col("i") - F.col("j")) < 3).select(F.concat(F.lit("T"), "i").alias("a"), F.concat(F.lit("T"), "j").alias("b"), (1.0 / (1 + F.abs(F.col("i") - F.col("j")))).alias("s"))
    path = place(spark, "matrix")
    sinks.matrix(m, path, [f"T{k}" for k in range(30)])
    return S.similarity_matrix(spark, path)


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL")
def text_lines(spark, d):
    """Texts as lines of plain, gzip and bzip2 files, whose codec the reader takes from their names."""
    t = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    parts = [written(t.where(F.col("doc_id") % 3 == k), F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("line", "\r", " ")), "lines", compression=c) for k, c in enumerate(("none", "gzip", "bzip2"))]
    out = S.lines(spark, parts[0]).union(S.lines(spark, parts[1])).union(S.lines(spark, parts[2]))
    return out.groupBy(F.substring_index("value", "\t", 1).cast("long").alias("doc_id")).agg(F.count("*").alias("n_lines"))
