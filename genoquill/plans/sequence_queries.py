"""Queries over sequences cut from the texts, distances, trees and inbreeding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequence as S
from ..functions import stats as T
from ..operators import inbreeding as B
from ..operators import mutation as M
from ..operators import trees as R
from .fixtures import ctes, frame
from .registry import query

#: A whole text as nucleotides: letters of its lower case that the translation names, others dropped.
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
SEQ = f"WITH seqs AS (SELECT doc_id, regexp_replace(translate(lower(coalesce(text, '')), '{_FROM}', '{_TO}'), '[^ACGT]', '', 'g') AS s FROM documents)"


def sequences(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    s = F.regexp_replace(F.translate(F.lower(F.coalesce("text", F.lit(""))), _FROM, _TO), "[^ACGT]", "")
    return t.select("doc_id", s.alias("s"))


@query(f"{SEQ} SELECT doc_id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, CAST(length(s) - length(replace(s, 'A', '')) AS BIGINT) AS a, CAST((length(s) - length(replace(s, 'CG', ''))) // 2 AS BIGINT) AS cg FROM seqs")
def strand_and_counts(spark, d):
    return sequences(spark, d).select("doc_id", S.reverse_complement("s").alias("rc"), S.count_text("s", "A").alias("a"), S.count_text("s", "CG").alias("cg"))


@query(f"{SEQ} SELECT doc_id, CASE WHEN length(s) > 0 THEN round(32.0::DOUBLE * ((length(s) - length(replace(s, 'CG', ''))) // 2) / length(s), 9) ELSE 0 END AS cpg FROM seqs")
def cpg_islands(spark, d):
    return sequences(spark, d).select("doc_id", F.round(S.cpg("s"), 9).alias("cpg"))


@query(f"{SEQ}, n AS (SELECT doc_id, length(s) AS n, unnest([length(s) - length(replace(s, 'A', '')), length(s) - length(replace(s, 'C', '')), length(s) - length(replace(s, 'G', '')), length(s) - length(replace(s, 'T', ''))]) AS k FROM seqs) SELECT doc_id, round(coalesce(sum(CASE WHEN k > 0 THEN -(k::DOUBLE / n) * ln(k::DOUBLE / n) END), 0) / ln(4), 9) AS entropy FROM n GROUP BY doc_id")
def alphabet_entropy(spark, d):
    return sequences(spark, d).select("doc_id", F.round(S.entropy("s"), 9).alias("entropy"))


#: Windows ACA: the places of AC that an A follows, without one at the very end.
_ACA = "len(list_filter(string_split(s, 'AC'), lambda e, i: i > 1 AND (starts_with(e, 'A') OR e = '' AND i < len(string_split(s, 'AC'))))) - CAST(s LIKE '%ACA' AS INT)"


@query(f"{SEQ} SELECT doc_id, CAST({_ACA} AS BIGINT) AS kmers, CAST(length(regexp_extract_all(s, 'TG[CT][ACGT]A'))  AS BIGINT) AS motifs FROM seqs")
def kmers_and_motifs(spark, d):
    return sequences(spark, d).select("doc_id", S.kmer_count("s", "ACA").alias("kmers"), S.motif_count("s", "TGYNA").alias("motifs"))


_CODES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.codon_table(1).items()) + "}"
_PROT = f"p AS (SELECT doc_id, s, array_to_string(list_transform(regexp_extract_all(s, '...'), lambda c: ({_CODES})[c]), '') AS protein FROM seqs)"


@query(f"{SEQ}, {_PROT} SELECT doc_id, protein, CAST(CASE WHEN strpos(protein, '*') > 0 THEN strpos(protein, '*') - 1 ELSE length(protein) END AS BIGINT) AS stop FROM p")
def translation(spark, d):
    t = sequences(spark, d).select("doc_id", S.translate("s").alias("protein"))
    return t.select("doc_id", "protein", S.first_stop("protein").alias("stop"))


_HEAD = "(SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'ATG' ELSE '' END, s, CASE WHEN doc_id % 2 = 0 THEN 'TAA' ELSE '' END) AS s FROM seqs)"


@query(f"""{SEQ}, {_PROT.replace('FROM seqs)', 'FROM ' + _HEAD + ' q)')}, v AS (SELECT CASE WHEN length(s) % 3 <> 0 OR length(s) = 0 THEN 'NOT_MOD3' WHEN substr(protein, 1, 1) <> 'M' THEN 'NO_START' WHEN strpos(protein, '*') > 0 AND strpos(protein, '*') - 1 < length(protein) - 1 THEN 'NONSENSE' WHEN right(protein, 1) <> '*' THEN 'NO_STOP' ELSE 'VALID' END AS code FROM p) SELECT code, count(*) AS n FROM v GROUP BY 1""")
def protein_validity(spark, d):
    t = sequences(spark, d)
    s = F.concat(F.when(F.col("doc_id") % 3 == 0, "ATG").otherwise(""), F.col("s"), F.when(F.col("doc_id") % 2 == 0, "TAA").otherwise(""))
    return t.select(S.validity(s).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS distance FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND b.p_partkey < a.p_partkey + 4")
def edit_distance_pairs(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    near = t.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), F.explode(F.array(*[F.col("p_partkey") + k for k in (1, 2, 3)])).alias("b"))
    return near.join(t.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y")), "b").select("a", "b", F.levenshtein("x", "y").cast("long").alias("distance"))


@query(
    """WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN length(a.p_name) <= length(b.p_type) THEN a.p_name ELSE b.p_type END AS s, CASE WHEN length(a.p_name) <= length(b.p_type) THEN b.p_type ELSE a.p_name END AS l
  FROM (SELECT p_partkey, upper(p_name) AS p_name FROM part) a JOIN part b ON b.p_partkey = a.p_partkey + 1),
u AS (SELECT DISTINCT s, l FROM p), c AS (SELECT s, l, substr(l, CAST(i AS INT), CAST(k AS INT)) AS x FROM u, range(1, 40) r(i), range(0, 40) q(k) WHERE i + k <= length(l) + 1), m AS (SELECT s, l, min(levenshtein(s, x)) AS distance FROM c GROUP BY 1, 2)
SELECT a, b, distance FROM p JOIN m USING (s, l)"""
)
def local_edit_distance(spark, d):
    """The name of each part against the type of the next one."""
    t = spark.read.parquet(f"{d}/part.parquet")
    near = t.select(F.col("p_partkey").alias("a"), F.upper("p_name").alias("x"), (F.col("p_partkey") + 1).alias("b"))
    return near.join(t.select(F.col("p_partkey").alias("b"), F.col("p_type").alias("y")), "b").select("a", "b", S.local_distance("x", "y").alias("distance"))


@query(None)
def lempel_ziv_complexity(spark, d):
    return sequences(spark, d).select("doc_id", S.lempel_ziv("s").alias("lz"))


@query(ctes("variants") + " SELECT CASE WHEN length(ref) = length(alt) THEN CASE WHEN ref = alt THEN '1M' ELSE '1X' END WHEN length(ref) > length(alt) THEN concat('1M', CAST(length(ref) - 1 AS VARCHAR), 'D') ELSE concat('1M', CAST(length(alt) - 1 AS VARCHAR), 'I') END AS cigar, count(*) AS n FROM variants GROUP BY 1")
def cigar_counts(spark, d):
    alleles = frame(spark, d, "variants").groupBy("ref", "alt").agg(F.count("*").alias("n"))
    return alleles.select(C.cigar("ref", "alt").alias("cigar"), "n").groupBy("cigar").agg(F.sum("n").alias("n"))


@query("SELECT l_linenumber AS k, round(exp(lgamma(l_linenumber + 2.5) - lgamma(7.0) - lgamma(l_linenumber + 0.5)), 6) AS ratio, count(*) AS n FROM lineitem GROUP BY 1, 2")
def log_gamma_values(spark, d):
    k = F.col("l_linenumber")
    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    k = F.col("k")
    return t.select("k", F.round(F.exp(T.log_gamma(k + 2.5) - T.log_gamma(F.lit(7.0)) - T.log_gamma(k + 0.5)), 6).alias("ratio"), "n")


@query("SELECT l_linenumber AS k, round(power(0.3, l_linenumber) * power(0.7, 10 - l_linenumber) * exp(lgamma(11) - lgamma(l_linenumber + 1) - lgamma(11 - l_linenumber)), 8) AS p FROM lineitem GROUP BY 1")
def binomial_values(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("k")).distinct()
    return t.select("k", F.round(T.binomial_pdf(F.col("k"), F.lit(10), F.lit(0.3)), 8).alias("p"))


_LOCI = "loci AS (SELECT contig_id, pos, avg(af) AS f FROM variants WHERE af > 0.05 AND af < 0.95 GROUP BY 1, 2), g AS (SELECT genome_id, contig_id, pos, count(*) AS n FROM variants GROUP BY 1, 2, 3), o AS (SELECT s.genome_id, l.contig_id, l.pos, f, coalesce(n, 0) AS n FROM loci l CROSS JOIN (SELECT DISTINCT genome_id FROM variants) s LEFT JOIN g ON g.genome_id = s.genome_id AND g.contig_id = l.contig_id AND g.pos = l.pos)"


def _observed(spark, d):
    v = frame(spark, d, "variants")
    loci = v.where("af > 0.05 AND af < 0.95").groupBy("contig_id", "pos").agg(F.avg("af").alias("f"))
    return B.observe(loci, v)


@query(ctes("variants") + f", {_LOCI} SELECT genome_id, count(*) AS loci, round((sum(CASE WHEN n <> 1 THEN 1 ELSE 0 END) - sum(1 - 2 * f * (1 - f))) / (count(*) - sum(1 - 2 * f * (1 - f))), 9) AS f_simple FROM o GROUP BY 1")
def inbreeding_simple(spark, d):
    return B.simple(_observed(spark, d)).withColumn("f_simple", F.round("f_simple", 9))


@query(ctes("variants") + f", {_LOCI}, h AS (SELECT *, CASE WHEN n = 0 THEN 1 - f ELSE f END AS q FROM o) SELECT genome_id, count(CASE WHEN n = 1 OR q > 0.001 THEN 1 END) AS loci, round(sum(CASE WHEN n = 1 THEN -1 WHEN q > 0.001 THEN 1 / q - 1 ELSE 0 END) / count(CASE WHEN n = 1 OR q > 0.001 THEN 1 END), 9) AS f_ritland FROM h GROUP BY 1")
def inbreeding_ritland(spark, d):
    return B.ritland(_observed(spark, d)).withColumn("f_ritland", F.round("f_ritland", 9))


@query(None)
def inbreeding_hall(spark, d):
    return B.hall(_observed(spark, d))


@query(None)
def inbreeding_likelihood(spark, d):
    return B.log_likelihood(_observed(spark, d))


@query(ctes("variants") + f", {_LOCI} SELECT contig_id, round(avg(f * f), 9) AS hom, round(avg(2 * f * (1 - f)), 9) AS het, count(*) AS loci FROM loci GROUP BY 1")
def class_frequencies(spark, d):
    v = frame(spark, d, "variants")
    loci = v.where("af > 0.05 AND af < 0.95").groupBy("contig_id", "pos").agg(F.avg("af").alias("f"))
    k = B.class_frequencies(F.col("f"))
    return loci.groupBy("contig_id").agg(F.round(F.avg(k["minor_homozygous"]), 9).alias("hom"), F.round(F.avg(k["heterozygous"]), 9).alias("het"), F.count("*").alias("loci"))


@query(None)
def synthetic_population(spark, d):
    v = frame(spark, d, "variants")
    loci = v.where("af > 0.05 AND af < 0.95").groupBy("contig_id", "pos").agg(F.avg("af").alias("f"))
    return B.synthetic(loci, [0.0, 0.25, 0.5], per_value=3, seed=11)


_VEC = "v AS (SELECT vec_id AS id, embedding AS e FROM embeddings)"


@query(f"WITH {_VEC} SELECT a.id AS i, b.id AS j, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))), 6) AS d FROM v a JOIN v b ON a.id > b.id")
def distance_matrix(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return R.euclidean(v, "vec_id", "embedding").withColumn("d", F.round("d", 6))


@query(f"WITH {_VEC}, m AS (SELECT a.id AS i, b.id AS j, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))) AS d FROM v a JOIN v b ON a.id <> b.id), r AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM m) SELECT i, j AS nearest, round(d / (SELECT max(d) FROM m), 6) AS d FROM r WHERE k = 1")
def nearest_neighbour(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return R.nearest_vectors(v, "vec_id", "embedding").withColumn("d", F.round("d", 6))


@query(None)
def upgma_heights(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return R.upgma_vectors(v, "vec_id", "embedding")


@query(None)
def transcript_mutation(spark, d):
    """Six genes of every contig spliced, mutated by each genome's variants, translated and checked."""
    v = frame(spark, d, "variants")
    base = F.concat(*[F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.lit(i) * 7 + 3) % 4 + 1) for i in range(16)])
    contigs = v.select("contig_id").distinct().select("contig_id", F.repeat(base, 26).alias("sequence"))
    genes = contigs.select("contig_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).select(F.concat("contig_id", F.lit(":"), "k").alias("transcript"), "contig_id", F.when(F.col("k") % 2 == 0, "+").otherwise("-").alias("strand"), F.array(F.struct((F.col("k") * 60 + 3).cast("long").alias("lower"), (F.col("k") * 60 + 24).cast("long").alias("upper")), F.struct((F.col("k") * 60 + 33).cast("long").alias("lower"), (F.col("k") * 60 + 51).cast("long").alias("upper"))).alias("exons"))
    return M.mutate(M.agreeing(v, contigs), genes, contigs)
