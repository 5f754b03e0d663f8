"""Predicates over variants, genomes and publications, and the filters that look at all variants of a locus.

Row predicates are columns without nulls, so that they can be negated and combined; a policy says whether missing
evidence passes. Locus filters are functions from frame to frame. `keys` are the columns of a genome's contig, `pos` the
position; the order of rows is given where a first one counts.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import variants as V

KEYS, POS, ORDER = ("genome_id", "contig_id"), "pos", ("vcf_line", "part", "supp")


def settled(predicate: Column, missing: bool = False) -> Column:
    """predicate with missing in place of null."""
    return F.coalesce(predicate, F.lit(missing))


def all_of(*p: Column) -> Column:
    return reduce(lambda a, b: a & b, p, F.lit(True))


def any_of(*p: Column) -> Column:
    return reduce(lambda a, b: a | b, p, F.lit(False))


def negate(p: Column) -> Column:
    return ~settled(p)


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


def snp(ref: str = "ref", alt: str = "alt") -> Column:
    return V.is_snp(ref, alt)


def passed(column: str = "pass") -> Column:
    return settled(F.col(column))


def phase_is(phase: int, column: str = "phase") -> Column:
    return settled(F.col(column) == phase)


def depth_at_least(n: int, column: str = "dp") -> Column:
    """Missing depth passes."""
    return settled(F.col(column) >= n, True)


def counts_at_least(n: int, ref_count: str = "ref_count", alt_count: str = "alt_count") -> Column:
    return settled(F.col(ref_count) + F.col(alt_count) >= n, True)


def info(predicate: Callable[[Column], Column], column: str, missing: bool) -> Column:
    """A predicate of one's own on an evidence column."""
    return F.when(F.col(column).isNull(), F.lit(missing)).otherwise(settled(predicate(F.col(column)), missing))


def vep_contains(records: str, field: str, text: str, compat: bool = True) -> Column:
    """Whether a record's field contains text. With compat an empty text looks at the first record only, and no records never pass."""
    r = F.col(records)
    if compat and text == "":
        return settled(F.get(r, F.lit(0))[field] == "")
    return settled(F.exists(r, lambda x: F.contains(x[field], F.lit(text))))


def frequency_at_least(cutoff: float, values: str, alt_index: str | None = None, alt_count: str | None = None) -> Column:
    """Missing passes; an array of the wrong width doesn't."""
    if alt_index is None:
        return settled(F.col(values) >= cutoff, True)
    v = F.col(values)
    return F.when(v.isNull(), True).when(F.size(v) != F.col(alt_count), False).otherwise(settled(F.get(v, F.col(alt_index)) >= cutoff, True))


def pf7_quality(vqslod="vqslod", qd="qd", mq="mq", sor="sor", mq_rank="mq_rank_sum", pos_rank="read_pos_rank_sum", mitochondrial: Column | None = None) -> Column:
    """VQSLOD alone where there is one, else the five hard filters; each of them passes if missing."""
    ok = lambda c, p: settled(p(F.col(c)), True)
    least = F.when(settled(mitochondrial) if mitochondrial is not None else F.lit(False), 5.0).otherwise(30.0)
    hard = all_of(ok(qd, lambda x: x >= 2.0), ok(mq, lambda x: x >= least), ok(sor, lambda x: x <= 3.0), ok(mq_rank, lambda x: x >= -12.5), ok(pos_rank, lambda x: x >= -8.0))
    return F.when(F.col(vqslod).isNotNull(), F.col(vqslod) >= 0).otherwise(hard)


def gnomad_quality(df: DataFrame, vqslod: str = "vqslod", forest: str = "rf_tp_probability") -> DataFrame:
    return df.where(info(lambda x: x >= 1.2168, vqslod, False) & info(lambda x: x >= 0.90, forest, False))


def pathogenic(column: str = "clnsig") -> Column:
    return settled(F.contains(F.upper(F.col(column)), F.lit("PATHOGENIC")))


def statistics(df: DataFrame, predicates: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per named (column, predicate): accepted, rejected and missing rows and their percentages; one pass."""
    n, out = F.count("*"), []
    for name, (column, p) in predicates.items():
        missing, ok = F.col(column).isNull(), settled(p)
        out.append(F.struct(F.lit(name).alias("filter"), F.count_if(~missing & ok).alias("accepted"), F.count_if(~missing & ~ok).alias("rejected"), F.count_if(missing).alias("missing"), n.alias("total")))
    t = df.agg(F.array(*out).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return t.select("*", *[F.when(F.col("total") > 0, 100.0 * F.col(c) / F.col("total")).otherwise(0.0).alias(f"{c}_percent") for c in ("accepted", "rejected", "missing")])


def before_after(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: rows before and after a filter."""
    return df.agg(F.count("*").alias("before"), F.count_if(settled(predicate)).alias("after"))


def with_hgvs(df: DataFrame) -> DataFrame:
    return df if "hgvs" in df.columns else df.withColumn("hgvs", V.hgvs())


def _over(*cols: str):
    return W.partitionBy(*cols)


def homozygous_offsets(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = POS) -> DataFrame:
    """Rows of loci with exactly two variants, both the same."""
    t = with_hgvs(df).withColumn("_n", F.count("*").over(_over(*keys, pos))).withColumn("_same", F.count("*").over(_over(*keys, pos, "hgvs")))
    return t.where("_n = 2 AND _same = 2").drop("_n", "_same")


def heterozygous_offsets(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = POS) -> DataFrame:
    """Rows whose variant occurs once at its locus."""
    return with_hgvs(df).withColumn("_same", F.count("*").over(_over(*keys, pos, "hgvs"))).where("_same = 1").drop("_same")


def diploid_offsets(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = POS) -> DataFrame:
    """Rows of loci with two variants at most."""
    return df.withColumn("_n", F.count("*").over(_over(*keys, pos))).where("_n <= 2").drop("_n")


def unique_unphased(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = POS, order: Sequence[str] = ORDER) -> DataFrame:
    """The first row of each variant at a locus."""
    t = with_hgvs(df).withColumn("_k", F.row_number().over(_over(*keys, pos, "hgvs").orderBy(*order)))
    return t.where("_k = 1").drop("_k")


def unique_phased(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = POS, order: Sequence[str] = ORDER, phase: str = "phase") -> DataFrame:
    t = with_hgvs(df).withColumn("_k", F.row_number().over(_over(*keys, pos, "hgvs", phase).orderBy(*order)))
    return t.where("_k = 1").drop("_k")


def region(start: int, end: int, pos: str = POS) -> Column:
    return (F.col(pos) >= start) & (F.col(pos) < end)


def modifies(start: int, end: int, margin: int = 500, pos: str = POS) -> Column:
    """Variants that modify [start, end): deletes that intersect it, others whose member interval it contains."""
    near = (F.col(pos) >= max(start - margin, 0)) & (F.col(pos) < end + margin)
    inside = V._let(V.member_interval(pos=pos), lambda m: F.when(m["kind"] == "DELETE", (m["lower"] < end) & (m["upper"] > start)).otherwise((m["lower"] >= start) & (m["upper"] <= end)))
    return near & inside


def template(df: DataFrame, wanted: DataFrame, on: Sequence[str] = ("contig_id", "pos", "hgvs")) -> DataFrame:
    """Rows that occur in wanted: probe duplicates stay, those of wanted never multiply."""
    return with_hgvs(df).join(with_hgvs(wanted).select(*on), list(on), "left_semi")


def genomes_in(df: DataFrame, genomes: Sequence[str] | DataFrame, column: str = "genome_id") -> DataFrame:
    return df.join(genomes.select(column), column, "left_semi") if isinstance(genomes, DataFrame) else df.where(F.col(column).isin(list(genomes)))


def coding(df: DataFrame, how: str = "first", keys: Sequence[str] = KEYS, pos: str = POS, order: Sequence[str] = ORDER, af: str = "af") -> DataFrame:
    """One canonical variant per coding locus, an indel competing at the place behind it.

    how: first, highest_af (the last of equal ones, missing lowest), or homozygous (highest of the distinct variants).
    """
    t = with_hgvs(df).where(V.is_canonical())
    t = unique_unphased(t, keys, pos, order) if how == "homozygous" else t
    locus = F.col(pos) + F.when(V.is_snp(), 0).otherwise(1)
    ranks = [F.col(c) for c in order] if how == "first" else [F.coalesce(F.col(af), F.lit(0.0)).desc(), *[F.col(c).desc() for c in order]]
    t = t.withColumn("_locus", locus).withColumn("_k", F.row_number().over(_over(*keys, "_locus").orderBy(*ranks)))
    return t.where("_k = 1").drop("_k", "_locus")


def literature(chemicals: Sequence[str] = (), mesh: Sequence[str] = (), title: Sequence[str] = (), abstract: Sequence[str] = (), compat: bool = True) -> Column:
    """Any-of predicates on publications (columns chemicals and mesh: arrays; title, abstract: texts), joined by and.

    With compat the MeSH list is sought among the chemicals, and the title's words in the abstract.
    """
    p = []
    if chemicals:
        p.append(settled(F.arrays_overlap("chemicals", F.array(*map(F.lit, chemicals)))))
    if mesh:
        p.append(settled(F.arrays_overlap("chemicals" if compat else "mesh", F.array(*map(F.lit, mesh)))))
    for words, column in ((title, "abstract" if compat else "title"), (abstract, "abstract")):
        if words:
            p.append(any_of(*[settled(F.contains(F.lower(column), F.lit(w.lower()))) for w in words]))
    return all_of(*p)


#: Words that mark a publication on the malaria parasite; fixed values.
PLASMODIUM_WORDS = ("plasmodium", "falciparum", "malaria")


def plasmodium(compat: bool = True) -> Column:
    return literature(title=PLASMODIUM_WORDS, compat=compat) | literature(abstract=PLASMODIUM_WORDS)


def by_sample(df: DataFrame, samples: DataFrame, predicate: Column, on: str = "genome_id") -> DataFrame:
    """Rows of genomes whose sample record satisfies predicate; genomes without a record go."""
    return df.join(samples.where(settled(predicate)).select(on), on, "left_semi")


def fws_filter(df: DataFrame, samples: DataFrame, threshold: float, at_least: bool = True) -> DataFrame:
    return by_sample(df, samples, F.col("fws") >= threshold if at_least else F.col("fws") <= threshold)


def qc_filter(df: DataFrame, samples: DataFrame) -> DataFrame:
    return by_sample(df, samples, F.col("qc_pass"))


def coi_filter(df: DataFrame, samples: DataFrame) -> DataFrame:
    return by_sample(df, samples, F.col("coi") == 1)


def pf7_pipeline(df: DataFrame, samples: DataFrame, fws: float = 0.95, quality: Column | None = None, frequency: float | None = None, only_snp: bool = False) -> DataFrame:
    """QC, monoclonal samples, quality, and optionally frequency and SNP, in that order; one plan."""
    out = fws_filter(qc_filter(df, samples), samples, fws)
    out = out.where(quality) if quality is not None else out
    out = out.where(frequency_at_least(frequency, "af")) if frequency is not None else out
    return out.where(V.is_snp()) if only_snp else out


#: Evidence codes by class; fixed values.
EVIDENCE = {
    "EXPERIMENTAL": ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP"),
    "COMPUTATIONAL": ("ISS", "ISO", "ISA", "ISM", "IGC", "IBA", "IBD", "IKR", "IRD", "RCA"),
    "AUTHOR": ("TAS", "NAS"),
    "CURATOR": ("IC", "ND"),
    "ELECTRONIC": ("IEA",),
}


def evidence_policy(allowed: Sequence[str], column: str = "evidence") -> Column:
    """allowed: codes or names of classes."""
    codes = [c for a in allowed for c in EVIDENCE.get(a, (a,))]
    return settled(F.col(column).isin(codes))


def relationship_policy(allowed: Sequence[str], column: str = "relation") -> Column:
    """Allowed edge types; is_a and part_of must be among them."""
    if not {"is_a", "part_of"} <= set(allowed):
        raise ValueError("a policy needs is_a and part_of")
    return settled(F.col(column).isin(list(allowed)))


class Registry:
    """Named frame-to-frame filters, also of one's own, applied in order."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, f: Callable[..., DataFrame]) -> None:
        self.known[name] = f

    def apply(self, df: DataFrame, *steps: str | tuple[str, dict] | Column) -> DataFrame:
        for s in steps:
            if isinstance(s, Column):
                df = df.where(settled(s))
            else:
                name, options = (s, {}) if isinstance(s, str) else s
                df = self.known[name](df, **options)
        return df


FILTERS = Registry()
for _f in (homozygous_offsets, heterozygous_offsets, diploid_offsets, unique_unphased, unique_phased, coding):
    FILTERS.register(_f.__name__, _f)


def variant_only(step: str | Column) -> Column:
    """A step as a test of single variants: conditions as they are; filters of loci or contigs let no variant pass, with a warning."""
    if isinstance(step, Column):
        return settled(step)
    logging.getLogger(__name__).warning("%s is no filter of single variants", step)
    return F.lit(False)
