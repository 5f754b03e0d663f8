"""Reference features: hierarchies, transcripts, flanks and checks. features: feature_id, contig_id, type, lower, upper, strand, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from .joins import reference_at
from .ontology import closure

#: Types that count as one super type; fixed values.
SUPER_TYPES = {"GENE": ("GENE", "NCRNA_GENE", "PROTEIN_CODING_GENE", "PSEUDOGENE"), "MRNA": ("MRNA", "TRANSCRIPT", "NCRNA", "RRNA", "TRNA"), "CDS": ("CDS",), "EXON": ("EXON",), "UTR5": ("FIVE_PRIME_UTR",), "UTR3": ("THREE_PRIME_UTR",), "TSS": ("TSS",), "ENHANCER": ("ENHANCER",)}


def super_type(column: str = "type") -> Column:
    out = F.upper(column)
    for name, kinds in SUPER_TYPES.items():
        out = F.when(F.upper(column).isin(*kinds), name).otherwise(out)
    return out


def hierarchy(features: DataFrame) -> DataFrame:
    """(child, parent): the first parent of each feature that exists on its contig."""
    c = features.select("contig_id", F.col("feature_id").alias("child"), F.posexplode("parents").alias("k", "parent")).where("parent <> ''")
    known = features.select("contig_id", F.col("feature_id").alias("parent")).distinct()
    t = c.join(known, ["contig_id", "parent"], "left_semi")
    return t.groupBy("contig_id", "child").agg(F.min(F.struct("k", "parent")).alias("m")).select("contig_id", "child", F.col("m.parent").alias("parent"))


def without_duplicates(features: DataFrame, order: str = "lower") -> DataFrame:
    """Of features of one id the last by order."""
    w = W.partitionBy("contig_id", "feature_id").orderBy(F.col(order).desc(), F.col("upper").desc())
    return features.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def clamp(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """Bounds cut to the contig (contig_id, length); a start of 1 becomes 0."""
    t = features.join(contigs.select("contig_id", F.col("length").alias("_l")), "contig_id")
    return t.withColumns({"lower": F.when(F.col("lower") == 1, 0).otherwise(F.col("lower")), "upper": F.least("upper", "_l")}).drop("_l")


def misplaced(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Children that reach over their parents; start sites and UTRs are exempt."""
    p = features.select("contig_id", F.col("feature_id").alias("parent"), F.col("lower").alias("_lo"), F.col("upper").alias("_up"))
    t = features.withColumnRenamed("feature_id", "child").join(edges, ["contig_id", "child"]).join(p, ["contig_id", "parent"])
    return t.where(~super_type().isin("TSS", "UTR5", "UTR3")).where("lower < _lo OR upper > _up").select("contig_id", "child", "parent")


def transcripts(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(contig_id, gene_id, transcript, strand, kind, exons): the leaves below each gene by parent; CDS leaves alone if there are any, else exons."""
    genes = features.where(super_type() == "GENE").select("contig_id", F.col("feature_id").alias("ancestor"), "strand")
    c = closure(edges.select("child", "parent"))
    leaf = features.where(super_type().isin("CDS", "EXON", "ENHANCER")).select("contig_id", F.col("feature_id").alias("term"), super_type().alias("kind"), "lower", "upper", F.explode("parents").alias("transcript"))
    t = leaf.join(c.where("distance > 0").select("term", "ancestor"), "term").join(genes, ["contig_id", "ancestor"])
    coding = F.max(F.col("kind") == "CDS").over(W.partitionBy("contig_id", "ancestor"))
    t = t.withColumn("_cds", coding).where(~F.col("_cds") | (F.col("kind") == "CDS"))
    return t.groupBy("contig_id", F.col("ancestor").alias("gene_id"), "transcript", "strand").agg(F.max(F.when(F.col("kind") == "CDS", "PROTEIN").otherwise("NCRNA")).alias("kind"), F.sort_array(F.collect_set(F.struct("lower", "upper"))).alias("exons"))


def bounds(t: DataFrame) -> DataFrame:
    """Transcripts with start, end and the summed length of their exons."""
    size = F.aggregate("exons", F.lit(0).cast("long"), lambda a, x: a + x["upper"] - x["lower"])
    return t.withColumns({"start": F.array_min(F.transform("exons", lambda x: x["lower"])), "end": F.array_max(F.transform("exons", lambda x: x["upper"])), "coding_length": size})


def flank(size: int, side: int, length: Column, lower: str = "start", upper: str = "end", strand: str = "strand") -> Column:
    """struct of the 5' or 3' window of a transcript, cut to the contig."""
    left = (F.col(strand) == "+") == F.lit(side == 5)
    lo = F.when(left, F.greatest(F.col(lower) - size, F.lit(0))).otherwise(F.col(upper))
    up = F.when(left, F.col(lower)).otherwise(F.least(F.col(upper) + size, length))
    return F.struct(lo.cast("long").alias("lower"), up.cast("long").alias("upper"))


def coding_sequences(t: DataFrame, contigs: DataFrame) -> DataFrame:
    """Transcripts with coding, protein and validity; what isn't protein is NCRNA, without exons EMPTY.

    A transcript meets the windows of the contig that it lies in, not the whole contig.
    """
    low, up = F.array_min(F.transform("exons", lambda x: x["lower"])), F.array_max(F.transform("exons", lambda x: x["upper"]))
    s = t.withColumns({"_lo": F.coalesce(low, F.lit(0)).cast("long"), "_size": F.coalesce(up - low, F.lit(0)).cast("long")})
    s = reference_at(s, contigs.select("contig_id", "sequence"), "_lo", F.col("_size")).where("_reference IS NOT NULL")
    local = F.transform("exons", lambda x: F.struct((x["lower"] - F.col("_lo")).alias("lower"), (x["upper"] - F.col("_lo")).alias("upper")))
    s = s.withColumn("_local", local).withColumn("coding", S.stranded(S.splice("_reference", "_local"), "strand")).drop("_lo", "_size", "_local", "_reference")
    valid = F.when(F.size("exons") == 0, "EMPTY").when(F.col("kind") != "PROTEIN", "NCRNA").otherwise(S.validity("coding"))
    return s.withColumns({"protein": S.translate("coding"), "validity": valid})


def verify(t: DataFrame) -> DataFrame:
    """Per contig: transcripts, those of a length by 3, and those of each strand."""
    return t.groupBy("contig_id").agg(F.count("*").alias("transcripts"), F.count_if(F.length("coding") % 3 == 0).alias("mod3"), F.count_if(F.col("strand") == "+").alias("forward"), F.count_if(F.col("strand") == "-").alias("reverse"))


def equivalent(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def described(features: DataFrame, words: list[str], column: str = "description") -> DataFrame:
    """Features whose description holds one of the words, in any case."""
    p = F.lit(False)
    for w in words:
        p = p | F.contains(F.upper(column), F.lit(w.upper()))
    return features.where(F.coalesce(p, F.lit(False)))


def contig(contigs: DataFrame, contig_id: str, required: bool = False) -> DataFrame:
    """The rows of one contig; with required KeyError if there is none."""
    found = contigs.where(F.col("contig_id") == contig_id)
    if required and found.isEmpty():
        raise KeyError(contig_id)
    return found


def find(features: DataFrame, feature_id: str) -> DataFrame:
    """All features of one id; several may share it."""
    return features.where(F.col("feature_id") == feature_id)


def gene_map(features: DataFrame) -> DataFrame:
    """Genes by contig and end: (contig_id, upper, feature_id, lower, strand); of genes that end at one place the first by id."""
    g = features.where(super_type() == "GENE")
    return g.groupBy("contig_id", "upper").agg(F.min(F.struct("feature_id", "lower", "strand")).alias("g")).select("contig_id", "upper", "g.feature_id", "g.lower", "g.strand")


def genes_behind(genes: DataFrame, loci: DataFrame) -> DataFrame:
    """loci (contig_id, pos) with the first gene of gene_map that ends behind pos and begins at or before it; null if there is none."""
    from .joins import interval_join

    own = loci.select("contig_id", "pos").distinct().withColumn("_up", F.col("pos") + 1)
    hit = interval_join(own, genes, ["contig_id"], ("pos", "_up"), ("lower", "upper"), 1 << 10)
    first = hit.groupBy("contig_id", "pos").agg(F.min(F.struct("r_upper", "r_feature_id")).alias("g"))
    return loci.join(first.select("contig_id", "pos", F.col("g.r_feature_id").alias("gene_id")), ["contig_id", "pos"], "left")


def transcript_of(t: DataFrame, gene_id: str, transcript: str) -> DataFrame:
    """The transcripts of that name of the gene of that id."""
    return t.where((F.col("gene_id") == gene_id) & (F.col("transcript") == transcript))


def start_sites(features: DataFrame, sites: DataFrame) -> DataFrame:
    """(contig_id, site, gene_id): start sites (feature_id, assigned: ids) under the genes that they are assigned to; unknown genes are left out."""
    genes = features.where(super_type() == "GENE").select("contig_id", F.col("feature_id").alias("gene_id")).distinct()
    own = sites.select("contig_id", F.col("feature_id").alias("site"), F.explode("assigned").alias("gene_id"))
    return own.join(genes, ["contig_id", "gene_id"], "left_semi").select("contig_id", "site", "gene_id").distinct()


def extended(five: int, three: int, length: Column, lower: str = "start", upper: str = "end", strand: str = "strand", compat: bool = True) -> Column:
    """struct of a transcript's interval grown by windows at its ends; (0, 0) if one that is asked for adds nothing.

    With compat both windows are taken at the 3' end.
    """
    lo, up = F.col(lower).cast("long"), F.col(upper).cast("long")
    sides = [(five, 3 if compat else 5), (three, 3)]
    bad = F.lit(False)
    for size, side in sides:
        if size > 0:
            w = flank(size, side, length, lower, upper, strand)
            empty = w["upper"] <= w["lower"]
            lo, up = F.when(empty, lo).otherwise(F.least(lo, w["lower"])), F.when(empty, up).otherwise(F.greatest(up, w["upper"]))
            bad = bad | (up - lo <= F.col(upper) - F.col(lower))
    zero = F.lit(0).cast("long")
    return F.struct(F.when(bad, zero).otherwise(lo).alias("lower"), F.when(bad, zero).otherwise(up).alias("upper"))


def feature_text(*columns: str, sep: str = ", ") -> Column:
    """A feature on one line, as name: value of the columns that are known."""
    return F.concat_ws(sep, *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])


def introns(t: DataFrame) -> DataFrame:
    """(contig_id, gene_id, transcript, strand, lower, upper): the gaps between the exons of transcripts."""
    e = F.array_sort("exons")
    gaps = F.transform(F.sequence(F.lit(1), F.size("exons") - 1), lambda i: F.struct(e[i - 1]["upper"].alias("lower"), e[i]["lower"].alias("upper")))
    return t.where(F.size("exons") > 1).select("contig_id", "gene_id", "transcript", "strand", F.explode(gaps).alias("g")).where("g.upper > g.lower").select("contig_id", "gene_id", "transcript", "strand", "g.lower", "g.upper")


def intron_statistics(t: DataFrame, contigs: DataFrame, genes: DataFrame) -> DataFrame:
    """introns of the transcripts of genes (gene_id) with length, letters and counts of the A and B boxes on the gene's strand."""
    own = introns(t.join(genes.select("gene_id").distinct(), "gene_id", "left_semi"))
    s = reference_at(own, contigs, "lower", F.col("upper") - F.col("lower")).withColumn("text", S.stranded("_reference", "strand")).drop("_reference")
    return s.withColumns({"size": F.length("text"), "a_boxes": S.motif_count("text", S.A_BOX), "b_boxes": S.motif_count("text", S.B_BOX)}).drop("text")
