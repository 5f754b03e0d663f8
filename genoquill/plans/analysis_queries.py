"""Queries of the variant analyses: trimming, clinical records, genes, tiles, offsets, loci of populations, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import analysis as X
from ..operators import features as R
from .fixtures import HGVS, KIND, ctes, frame
from .registry import query
from .sequence_queries import SEQ, sequences

VAR = ctes("variants")
#: Clinical records: one for each change at every fifth place, two where the place is divided by 50.
RECORDS = "rec AS (SELECT DISTINCT contig_id, pos, ref, alt, gene, concat('D', CAST(pos % 9 AS VARCHAR)) AS clndn FROM variants WHERE pos % 5 = 0 UNION ALL SELECT DISTINCT contig_id, pos, ref, alt, gene, 'other' FROM variants WHERE pos % 50 = 0)"


def records(v):
    r = v.where("pos % 5 = 0").select(*X.GENOTYPE, "gene", F.concat(F.lit("D"), (F.col("pos") % 9).cast("string")).alias("clndn")).distinct()
    return r.union(v.where("pos % 50 = 0").select(*X.GENOTYPE, "gene", F.lit("other").alias("clndn")).distinct())


@query(f"{VAR}, g AS (SELECT DISTINCT genome_id, contig_id FROM variants), h AS (SELECT DISTINCT genome_id, contig_id FROM variants WHERE af > 0.9 AND supp % 3 = 0), t AS (SELECT g.genome_id, count(*) AS n, count(h.contig_id) AS k FROM g LEFT JOIN h USING (genome_id, contig_id) GROUP BY 1) SELECT CAST(sum(n - k) AS BIGINT) AS contigs_removed, count(CASE WHEN k = 0 THEN 1 END) AS genomes_removed FROM t")
def trim_empty(spark, d):
    v = frame(spark, d, "variants")
    return X.trim_counts(v.select("genome_id", "contig_id").distinct(), v.where("af > 0.9 AND supp % 3 = 0"))


@query(f"{VAR}, {RECORDS}, o AS (SELECT genome_id, contig_id, pos, ref, alt, count(*) AS n FROM variants GROUP BY ALL) SELECT genome_id, gene, clndn, contig_id, pos, ref, alt, n FROM o JOIN rec USING (contig_id, pos, ref, alt)")
def clinvar_join(spark, d):
    v = frame(spark, d, "variants")
    return X.clinvar_join(v, records(v))


def _clinvar(test):
    return f"""{VAR}, {RECORDS}, o AS (SELECT genome_id, contig_id, pos, ref, alt, count(*) AS n FROM variants GROUP BY ALL), t AS (SELECT gene, genome_id, contig_id, pos, ref, alt, {test} AS twice FROM o JOIN rec USING (contig_id, pos, ref, alt) GROUP BY ALL),
p AS (SELECT gene, genome_id, max(twice) AS twice FROM t GROUP BY 1, 2), n AS (SELECT gene, string_agg(DISTINCT clndn, '|' ORDER BY clndn) AS phenotypes FROM rec GROUP BY 1)
SELECT gene, count(*) AS genomes, count(CASE WHEN twice THEN 1 END) AS homozygous_genomes, any_value(phenotypes) AS phenotypes FROM p JOIN n USING (gene) GROUP BY 1"""


@query(_clinvar("count(*) > 1"))
def clinvar_genes(spark, d):
    v = frame(spark, d, "variants")
    return X.clinvar_summary(v, records(v)).withColumn("phenotypes", F.array_join("phenotypes", "|"))


@query(_clinvar("max(n) > 1"))
def clinvar_genes_of_subjects(spark, d):
    v = frame(spark, d, "variants")
    return X.clinvar_summary(v, records(v), compat=False).withColumn("phenotypes", F.array_join("phenotypes", "|"))


@query(ctes("samples") + ", ped AS (SELECT concat('G', CAST(n_nationkey AS VARCHAR)) AS individual, concat('F', CAST(n_regionkey AS VARCHAR)) AS family, concat('G', CAST(n_nationkey + 1 AS VARCHAR)) AS father FROM nation) SELECT genome_id, country, family, father FROM samples LEFT JOIN ped ON individual = genome_id")
def pedigree_join(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    g = n.select(F.concat(F.lit("G"), F.col("n_nationkey").cast("string")).alias("individual"), F.concat(F.lit("F"), F.col("n_regionkey").cast("string")).alias("family"), F.concat(F.lit("G"), (F.col("n_nationkey") + 1).cast("string")).alias("father"))
    return X.pedigree_join(frame(spark, d, "samples").select("genome_id", "country"), g)


@query(f"{VAR} SELECT identifier, string_agg(DISTINCT gene, '|' ORDER BY gene) AS genes FROM variants WHERE identifier <> '' AND gene LIKE 'ENSG%' GROUP BY 1")
def genes_of_alleles(spark, d):
    return X.genes_of_alleles(frame(spark, d, "variants")).withColumn("genes", F.array_join("genes", "|"))


_TRANSCRIPTS = "tr AS (SELECT contig_id, gene_id, concat(gene_id, '.', CAST(k AS VARCHAR)) AS transcript, lower, lower + 1 + (upper - lower) // (k + 2) AS m, upper FROM genes, range(3) r(k) WHERE k <= lower % 3)"


def _transcripts(g):
    """One to three transcripts of two exons each, or of one where nothing is between them."""
    t = g.select("*", F.explode(F.sequence(F.lit(0), (F.col("lower") % 3).cast("int"))).alias("k"))
    m = F.col("lower") + 1 + F.floor((F.col("upper") - F.col("lower")) / (F.col("k") + 2))
    e = F.array(F.struct("lower", m.cast("long").alias("upper")), F.struct((m + 1).cast("long").alias("lower"), F.col("upper").cast("long").alias("upper")))
    return t.select("contig_id", "gene_id", F.concat("gene_id", F.lit("."), F.col("k").cast("string")).alias("transcript"), "strand", F.filter(e, lambda x: x["upper"] > x["lower"]).alias("exons"))


@query(ctes("genes") + f", {_TRANSCRIPTS}, s AS (SELECT contig_id, gene_id, count(*) AS sequences, min(transcript) AS sequence_name, arg_min((m - lower) + greatest(upper - m - 1, 0), transcript) AS nucleotides, arg_min(1 + CASE WHEN upper > m + 1 THEN 1 ELSE 0 END, transcript) AS exons FROM tr GROUP BY 1, 2) SELECT contig_id, gene_id, upper - lower AS span, sequences, sequence_name, CAST(nucleotides AS BIGINT) AS nucleotides, exons FROM genes JOIN s USING (contig_id, gene_id)")
def gene_characteristics(spark, d):
    g = frame(spark, d, "genes")
    return X.gene_characteristics(g, _transcripts(g)).select("contig_id", "gene_id", "span", "sequences", "sequence_name", "nucleotides", "exons")


@query(ctes("genes") + f", {_TRANSCRIPTS} SELECT contig_id, gene_id, transcript, m AS lower, m + 1 AS upper FROM tr WHERE upper > m + 1")
def transcript_introns(spark, d):
    return R.introns(_transcripts(frame(spark, d, "genes"))).drop("strand")


_PIDX = "CAST(greatest(least(CASE WHEN n * 0.9 - 0.5 < 0 THEN -floor(-(n * 0.9 - 0.5) + 0.5) ELSE floor(n * 0.9 - 0.5 + 0.5) END, n - 1), 0) AS BIGINT)"


@query(f"""{VAR}, t AS (SELECT *, pos // 50 AS tile FROM variants), b AS (SELECT contig_id, tile, count(*) AS variants, count(CASE WHEN impact IN ('HIGH', 'MODERATE') THEN 1 END) AS consequence, greatest(count(CASE WHEN af >= 0.9 THEN 1 END), 1) AS at_least FROM t GROUP BY 1, 2),
r AS (SELECT contig_id, tile, af, dp, row_number() OVER (PARTITION BY contig_id, tile ORDER BY af) - 1 AS ka, row_number() OVER (PARTITION BY contig_id, tile ORDER BY dp) - 1 AS kd, count(*) OVER (PARTITION BY contig_id, tile) AS n FROM t WHERE af IS NOT NULL),
p AS (SELECT contig_id, tile, max(CASE WHEN ka = {_PIDX} THEN af END) AS frequency, max(CASE WHEN kd = {_PIDX} THEN dp END) AS depth FROM r GROUP BY 1, 2)
SELECT contig_id, tile, variants, consequence, at_least, coalesce(frequency, 0) AS frequency, coalesce(depth, 0) AS depth FROM b LEFT JOIN p USING (contig_id, tile)""")
def tile_info(spark, d):
    return X.tile_info(frame(spark, d, "variants"), 50, {"frequency": F.col("af"), "depth": F.col("dp")}, 0.9, 0.9)


@query(ctes("variants", "publications", "citations") + f""", c AS (SELECT DISTINCT concat('rs', CAST(cited_by % 400 AS VARCHAR)) AS rsid, pmid FROM citations), n AS (SELECT rsid, count(*) AS pmids, count(CASE WHEN mesh = 'D3' THEN 1 END) AS disease_pmids FROM c JOIN publications USING (pmid) GROUP BY 1),
g AS (SELECT identifier AS rsid, string_agg(DISTINCT gene, '|' ORDER BY gene) AS genes FROM variants WHERE identifier <> '' AND gene LIKE 'ENSG%' GROUP BY 1) SELECT rsid, pmids, disease_pmids, genes FROM n LEFT JOIN g USING (rsid) WHERE disease_pmids > 0""")
def disease_alleles(spark, d):
    c = frame(spark, d, "citations").select(F.concat(F.lit("rs"), (F.col("cited_by") % 400).cast("string")).alias("rsid"), "pmid")
    t = X.disease_alleles(c, frame(spark, d, "publications").where("mesh = 'D3'"), X.genes_of_alleles(frame(spark, d, "variants")))
    return t.withColumn("genes", F.array_join("genes", "|"))


@query(f"""{VAR}, long AS (SELECT 'all' AS population, contig_id, pos, af FROM variants UNION ALL SELECT 'even', contig_id, pos, CASE WHEN supp % 2 = 0 THEN af END FROM variants), loci AS (SELECT population, contig_id, pos, avg(af) AS af FROM long WHERE af >= 0.2 AND af <= 0.8 GROUP BY 1, 2, 3),
walk AS (SELECT population, contig_id, min(pos) AS pos FROM loci GROUP BY 1, 2 UNION ALL SELECT w.population, w.contig_id, min(l.pos) FROM walk w JOIN loci l ON l.population = w.population AND l.contig_id = w.contig_id AND l.pos >= w.pos + 11 GROUP BY 1, 2)
SELECT population, contig_id, pos, round(af, 9) AS af FROM walk JOIN loci USING (population, contig_id, pos)""")
def population_loci(spark, d):
    v = frame(spark, d, "variants").withColumn("af_even", F.when(F.col("supp") % 2 == 0, F.col("af")))
    return X.population_loci(v, {"all": "af", "even": "af_even"}, 11, 0.2, 0.8).withColumn("af", F.round("af", 9))


_SHIFTS = f"""k AS (SELECT *, {KIND} AS kind, row_number() OVER (PARTITION BY genome_id, contig_id, pos ORDER BY vcf_line) AS k FROM variants WHERE length(ref) <> length(alt)),
sh AS (SELECT genome_id, contig_id, pos + 1 AS spot, length(alt) - length(ref) AS change, sum(length(alt) - length(ref)) OVER (PARTITION BY genome_id, contig_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cumulative FROM k WHERE k = 1),
sp AS (SELECT *, greatest(-change, 0) AS deleted, spot + cumulative - change AS base FROM sh), loci AS (SELECT DISTINCT genome_id, contig_id, pos FROM variants WHERE length(ref) = length(alt)),
j AS (SELECT l.*, max(spot) AS spot FROM loci l LEFT JOIN sp s ON s.genome_id = l.genome_id AND s.contig_id = l.contig_id AND s.spot < l.pos GROUP BY l.genome_id, l.contig_id, l.pos),
mo AS (SELECT j.genome_id, j.contig_id, j.pos, CASE WHEN s.spot IS NOT NULL AND j.pos < s.spot + deleted THEN base ELSE j.pos + coalesce(cumulative, 0) END AS modified FROM j LEFT JOIN sp s ON s.genome_id = j.genome_id AND s.contig_id = j.contig_id AND s.spot = j.spot)"""


@query(f"{VAR}, {_SHIFTS} SELECT genome_id, contig_id, count(*) AS n, CAST(sum(CASE WHEN modified >= 0 THEN modified END) AS BIGINT) AS modified FROM mo GROUP BY 1, 2")
def offset_translation(spark, d):
    v = frame(spark, d, "variants")
    loci = v.where(F.length("ref") == F.length("alt")).select("genome_id", "contig_id", "pos").distinct()
    t = X.to_modified(loci, X.indel_shifts(v))
    return t.groupBy("genome_id", "contig_id").agg(F.count("*").alias("n"), F.sum("modified").alias("modified"))


@query("SELECT a.vec_id AS i, b.vec_id AS j, CAST(2 * abs(a.vec_id - b.vec_id) AS DOUBLE) AS d FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id AND a.vec_id < b.vec_id + 3")
def matrix_add(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i"))
    m = e.select("i", F.explode(F.array(F.col("i") - 1, F.col("i") - 2)).alias("j")).join(e.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", F.abs(F.col("i") - F.col("j")).cast("double").alias("d"))
    return X.matrix_add(m, m)


@query(f"{SEQ} SELECT doc_id, CAST(len(regexp_extract_all(s, '{S.motif_regex(S.A_BOX)}')) AS BIGINT) AS a_boxes, CAST(len(regexp_extract_all(s, '{S.motif_regex(S.B_BOX)}')) AS BIGINT) AS b_boxes, coalesce(strpos(s, regexp_extract(s, '{S.motif_regex(S.A_BOX)}')) - 1, -1) AS first_a FROM seqs")
def promoter_boxes(spark, d):
    t = sequences(spark, d)
    at = F.regexp_instr("s", F.lit(f"({S.motif_regex(S.A_BOX)})"))
    return t.select("doc_id", S.motif_count("s", S.A_BOX).alias("a_boxes"), S.motif_count("s", S.B_BOX).alias("b_boxes"), F.when(at > 0, at - 1).otherwise(0).cast("long").alias("first_a"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS items FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_items(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    both = t.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), (F.col("p_partkey") + 1).alias("b")).join(t.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y")), "b")
    return both.select("a", "b", F.size(S.edits("x", "y")).cast("long").alias("items"))


@query(ctes("genes") + " SELECT contig_id, upper, min(gene_id) AS gene_id, count(*) AS genes FROM genes GROUP BY 1, 2")
def gene_map(spark, d):
    g = frame(spark, d, "genes").withColumn("type", F.lit("gene")).withColumnRenamed("gene_id", "feature_id")
    n = g.groupBy("contig_id", "upper").agg(F.count("*").alias("genes"))
    return R.gene_map(g).select("contig_id", "upper", F.col("feature_id").alias("gene_id")).join(n, ["contig_id", "upper"])


@query(ctes("genes") + ", s AS (SELECT DISTINCT contig_id, gene_id AS site, concat('g', CAST(CAST(substr(gene_id, 2) AS BIGINT) + 5 AS VARCHAR)) AS gene_id FROM genes) SELECT s.* FROM s JOIN genes g ON g.contig_id = s.contig_id AND g.gene_id = s.gene_id")
def start_sites(spark, d):
    g = frame(spark, d, "genes").withColumn("type", F.lit("gene")).withColumnRenamed("gene_id", "feature_id")
    sites = g.select("contig_id", "feature_id", F.array(F.concat(F.lit("g"), (F.substring("feature_id", 2, 20).cast("long") + 5).cast("string"))).alias("assigned"))
    return R.start_sites(g, sites)


@query(ctes("genes") + """, w AS (SELECT *, CASE WHEN strand = '+' THEN upper ELSE greatest(lower - 10, 0) END AS l5, CASE WHEN strand = '+' THEN least(upper + 10, 440) ELSE lower END AS u5, CASE WHEN strand = '+' THEN upper ELSE greatest(lower - 4, 0) END AS l3, CASE WHEN strand = '+' THEN least(upper + 4, 440) ELSE lower END AS u3 FROM genes)
SELECT gene_id, CASE WHEN u5 <= l5 OR u3 <= l3 THEN 0 ELSE least(lower, l5, l3) END AS lower, CASE WHEN u5 <= l5 OR u3 <= l3 THEN 0 ELSE greatest(upper, u5, u3) END AS upper FROM w""")
def extended_intervals(spark, d):
    g = frame(spark, d, "genes")
    return g.select("gene_id", R.extended(10, 4, F.lit(440).cast("long"), "lower", "upper").alias("x")).select("gene_id", "x.lower", "x.upper")


@query(ctes("annotations") + ", a AS (SELECT DISTINCT gene, term FROM annotations), t AS (SELECT concat('a', CAST(p_partkey AS VARCHAR)) AS gene FROM part WHERE p_partkey % 20 = 0) SELECT t.gene, count(a.term) AS terms FROM t LEFT JOIN a USING (gene) GROUP BY 1")
def target_genes(spark, d):
    a = frame(spark, d, "annotations")
    t = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 20 = 0").select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("gene"))
    return X.target_genes(a, t, a.select("term").distinct().withColumn("ic", F.lit(1.0))).select("gene", "terms")


@query(f"{VAR}, g AS (SELECT DISTINCT gene AS gene_id FROM variants), u AS (SELECT gene, count(DISTINCT {HGVS}) AS unique_variants, count(*) AS variants FROM variants GROUP BY 1) SELECT gene_id AS gene, unique_variants, variants FROM g JOIN u ON gene = gene_id")
def gene_report(spark, d):
    v = frame(spark, d, "variants")
    c = v.select(F.col("gene").alias("gene_id")).distinct()
    return X.gene_report(c, v, frame(spark, d, "samples"), ["P0", "P1"], records(v)).select("gene", "unique_variants", "variants")
