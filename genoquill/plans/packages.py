"""Registered analyses: named functions from source frames and typed parameters to report frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import inbreeding as B
from ..operators import joins as J
from ..operators import literature as L
from ..operators import mutation as M
from ..operators import ordered as O


@dataclass
class Parameters:
    """Texts by name, read as typed values with defaults."""

    values: dict[str, str] = field(default_factory=dict)

    def text(self, name: str, default: str = "") -> str:
        return self.values.get(name, default)

    def integer(self, name: str, default: int = 0) -> int:
        return int(self.values.get(name, default))

    def number(self, name: str, default: float = 0.0) -> float:
        return float(self.values.get(name, default))

    def flag(self, name: str, default: bool = False) -> bool:
        return str(self.values.get(name, default)).strip().lower() in ("1", "true", "yes")


PACKAGES: dict[str, Callable[[dict[str, DataFrame], Parameters], dict[str, DataFrame]]] = {}


def package(name: str):
    def add(f):
        PACKAGES[name] = f
        return f

    return add


def run(name: str, sources: dict[str, DataFrame], parameters: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The reports of one analysis. An analysis that lacks a source raises KeyError with its name."""
    return PACKAGES[name](sources, Parameters(dict(parameters or {})))


@package("null")
def null(sources, p):
    return {}


@package("interval")
def interval(sources, p):
    """Tiles of interval_size with counts and gaps."""
    v, size = sources["variants"], p.integer("interval_size", 1000)
    return {"tiles": A.tiles(v, size, p.integer("contig_length") or None), "gaps": O.tile_gaps(v, size)}


@package("info_filter")
def info_filter(sources, p):
    """Quality filter and a sweep over frequencies."""
    v = sources["variants"].where(P.info(lambda x: x >= p.number("vqslod", 0.0), "vqslod", False))
    return {"sweep": A.sweep(v, "af", [i / 20 for i in range(20)])}


@package("inbreeding")
def inbreeding(sources, p):
    """Estimators over spaced loci of SNPs that pass."""
    v = sources["variants"].where(V.is_snp() & P.passed())
    loci = O.spaced_loci(v, p.integer("spacing", 10), p.number("lowest", 0.05), p.number("highest", 0.95)).withColumnRenamed("af", "f")
    o = B.observe(loci, v)
    return {"loci": loci, "simple": B.simple(o), "ritland": B.ritland(o), "hall": B.hall(o), "likelihood": B.log_likelihood(o)}


@package("pfemp")
def pfemp(sources, p):
    """Monoclonal, well-covered samples: variants of genes, genotypes and diversity, zygosity, frequency bins, locations."""
    samples = sources["samples"]
    v = P.pf7_pipeline(sources["variants"], samples, p.number("fws", 0.95), P.info(lambda x: x >= 0, "vqslod", True))
    genes = J.gene_variants(v, sources["genes"]).withColumnRenamed("r_gene_id", "gene_id")
    groups = A.genotype_groups(genes, ["gene_id"])
    z = A.zygosity(v)
    n = samples.select("genome_id").distinct().count()
    return {"gene_genotypes": groups, "diversity": A.diversity(groups, n, ["gene_id"]), "zygosity": z, "fws": A.fws_bins(v), "locations": A.location_summary(z, samples, J.radius_join(samples, p.number("radius", 0.0)))}


@package("mutation")
def mutation(sources, p):
    """Gene effects, carriers and populations of variants that pass at loci of two at most."""
    v = P.diploid_offsets(sources["variants"].where(P.passed()))
    populations = [r[0] for r in sources["samples"].select("population").distinct().orderBy("population").collect()]  # a column of the report each
    return {"effects": A.gene_effects(v), "carriers": A.gene_carriers(v, "gene"), "ethnicity": A.ethnicity(v, sources["samples"], populations, ["gene"])}


@package("json")
def citations(sources, p):
    return {"citations": L.reverse_index(sources["citations"])}


@package("literature")
def literature(sources, p):
    pubs, c = sources["publications"], sources["citations"]
    pairs = L.cited_pairs(pubs, c)
    return {"authors": L.by_author(pubs, c), "years": L.grouped(pubs, c, F.col("year"), "year"), "journals": L.grouped(pubs, c, F.col("journal"), "journal"), "months": L.citation_months(pairs), "percent": L.citation_percent(pairs), "arrivals": L.citation_arrivals(pairs), "distribution": L.citation_distribution(pubs, c), "bibliography": pubs.select("pmid", L.bibliography().alias("line"))}


@package("sequence")
def sequence(sources, p):
    m = M.mutate(sources["variants"], sources["transcripts"], sources["contigs"], p.text("filter", "default"))
    return {"mutated": m, "validity": M.validity_tally(m), "families": M.transcript_families(m)}
