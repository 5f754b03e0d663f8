"""Inbreeding estimators over reference loci (contig_id, pos, f), f being the frequency of the minor allele."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import minimise


def observe(loci: DataFrame, variants: DataFrame) -> DataFrame:
    """(genome_id, contig_id, pos, f, n): for every genome and locus how often the genome has the minor allele, 0 included.

    The grid of genomes and loci is the caller's choice of loci; it is what the estimators are defined on.
    """
    genomes = variants.select("genome_id").distinct()
    n = variants.groupBy("genome_id", "contig_id", "pos").agg(F.count("*").alias("n"))
    grid = loci.select("contig_id", "pos", "f").join(genomes)
    return grid.join(n, ["genome_id", "contig_id", "pos"], "left").fillna({"n": 0})


def class_frequencies(f: Column, inbreeding: float | Column = 0.0) -> Column:
    """struct of the expected shares of the genotype classes at inbreeding F."""
    q, i = 1 - f, F.lit(inbreeding) if isinstance(inbreeding, float) else inbreeding
    return F.struct((f * f * (1 - i) + f * i).alias("minor_homozygous"), (2 * f * q * (1 - i)).alias("heterozygous"), (q * q * (1 - i) + q * i).alias("major_homozygous"))


def allele_vector(alleles: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(contig_id, pos, total, valid) of loci: frequencies clamped to 0 and 1, one of each allele, valid if they sum to 1 at most."""
    a = alleles.where("af IS NOT NULL").groupBy("contig_id", "pos", "ref", "alt").agg(F.max(F.least(F.greatest("af", F.lit(0.0)), F.lit(1.0))).alias("af"))
    return a.groupBy("contig_id", "pos").agg(F.sum("af").alias("total")).withColumn("valid", F.col("total") <= 1 + tolerance)


def simple(observed: DataFrame) -> DataFrame:
    """(homozygous - expected) / (loci - expected)."""
    hom, e, n = F.sum(F.when(F.col("n") != 1, 1).otherwise(0)), F.sum(1 - 2 * F.col("f") * (1 - F.col("f"))), F.count("*")
    return observed.groupBy("genome_id").agg(n.alias("loci"), F.when(n != e, (hom - e) / (n - e)).otherwise(0.0).alias("f_simple"))


def ritland(observed: DataFrame, least: float = 0.001) -> DataFrame:
    """Mean over loci of 1 / q - 1 for homozygous of frequency q > least, and -1 for heterozygous; others aren't counted."""
    q = F.when(F.col("n") == 0, 1 - F.col("f")).otherwise(F.col("f"))
    t = observed.withColumn("_r", F.when(F.col("n") == 1, -1.0).when(q > least, 1 / q - 1))
    return t.groupBy("genome_id").agg(F.count("_r").alias("loci"), F.coalesce(F.avg("_r"), F.lit(0.0)).alias("f_ritland"))


def _per_genome(observed: DataFrame, name: str, f) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hom = rows["n"].to_numpy() != 1
        q = np.where(rows["n"].to_numpy() == 0, 1 - rows["f"].to_numpy(), rows["f"].to_numpy())
        return pd.DataFrame({"genome_id": rows["genome_id"].iloc[:1], "loci": len(rows), name: f(hom, q, rows["f"].to_numpy())})

    return observed.groupBy("genome_id").applyInPandas(run, f"genome_id string, loci long, {name} double")


def hall(observed: DataFrame, start: float = 0.5, least: int = 50, most: int = 1000, tolerance: float = 1e-4) -> DataFrame:
    """Expectation-maximisation: share of loci that are alike by descent, heterozygous ones never being so."""

    def fit(hom: np.ndarray, q: np.ndarray, f: np.ndarray) -> float:
        x = start
        for k in range(most):
            new = float(np.where(hom, x / np.maximum(x + q * (1 - x), 1e-12), 0.0).sum() / len(hom))
            done, x = abs(new - x) < tolerance, new
            if done and k >= least:
                break
        return x

    return _per_genome(observed, "f_hall", fit)


def log_likelihood(observed: DataFrame, least: float = 1e-10) -> DataFrame:
    """Maximum of the likelihood of the genotype classes over F in [-1, 1], the best of four searches that start apart."""

    def fit(hom: np.ndarray, q: np.ndarray, f: np.ndarray) -> float:
        def loss(x: float) -> float:
            p = np.where(hom, q * q * (1 - x) + q * x, 2 * f * (1 - f) * (1 - x))
            return -float(np.log(np.clip(p, least, None)).sum())

        return min((minimise(loss, a, a + 0.5) for a in (-1.0, -0.5, 0.0, 0.5)), key=loss)

    return _per_genome(observed, "f_likelihood", fit)


def synthetic(loci: DataFrame, values: Sequence[float], per_value: int = 10, seed: int = 1) -> DataFrame:
    """Genomes drawn at given inbreeding: (genome_id, contig_id, pos, n); the id holds the value, see name_value.

    A draw depends on the seed, the genome and the locus only, not on partitions.
    """
    ids = [(f"SYN_{v:+.4f}_{k}", float(v)) for v in values for k in range(per_value)]
    g = loci.sparkSession.createDataFrame(ids, "genome_id string, value double")
    t = loci.join(F.broadcast(g))  # as many rows as the caller asks for
    u = (F.pmod(F.xxhash64(F.lit(seed), "genome_id", "contig_id", "pos"), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    k = class_frequencies(F.col("f"), F.col("value"))
    t = t.select("genome_id", "contig_id", "pos", u, k.alias("k"))
    return t.select("genome_id", "contig_id", "pos", F.when(F.col("u") < F.col("k.minor_homozygous"), 2).when(F.col("u") < F.col("k.minor_homozygous") + F.col("k.heterozygous"), 1).otherwise(0).alias("n"))


def name_value(genome_id: Column) -> Column:
    """The inbreeding value in a synthetic id."""
    return F.regexp_extract(genome_id, r"^SYN_([+-][0-9.]+)_", 1).try_cast("double")
