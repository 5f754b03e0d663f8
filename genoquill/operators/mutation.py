"""Transcript mutation: a genome's variants applied in order to spliced reference sequences."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import variants as V
from . import filters as P
from . import ordered as O
from .joins import interval_join, reference_at

#: Row filters by name: what they leave out beside variants that don't modify the transcript.
SELECTORS = {"default": None, "highest_freq": "highest_af", "frameshift": "frameshift", "snp": "snp"}


def agreeing(variants: DataFrame, contigs: DataFrame) -> DataFrame:
    """variants with their reference text set to what stands in the contig (contig_id, sequence), and an alternate that differs from it."""
    t = reference_at(variants, contigs, "pos", F.length("ref")).where("_reference IS NOT NULL")
    r = F.col("_reference")
    kind = V.variant_type()
    anchor = F.substring(r, 1, 1)
    a = F.when(kind == "DELETE", anchor).when(kind == "INSERT", F.concat(anchor, F.substring("alt", F.lit(2), F.length("alt")))).otherwise(F.translate(anchor, "ACGT", "GTAC"))
    return t.withColumns({"_r": r, "_a": a}).where(F.length("_r") == F.length("ref")).drop("ref", "alt", "_reference").withColumnsRenamed({"_r": "ref", "_a": "alt"})


def select(variants: DataFrame, how: str = "default", compat: bool = True) -> DataFrame:
    """One variant per coding locus and none that an earlier kept delete removed; with compat `snp` leaves out frame shifts only."""
    kind = SELECTORS[how]
    t = variants
    if kind == "frameshift" or kind == "snp" and compat:
        t = t.where(~V.is_frameshift())
    elif kind == "snp":
        t = t.where(V.is_snp())
    t = P.coding(t, "highest_af" if kind == "highest_af" else "homozygous")
    return O.upstream_deletes(t)


def apply_variants(sequence: str, start: int, edits: Sequence[tuple[int, str, str]]) -> tuple[str | None, list[tuple[int, int]]]:
    """The sequence of [start, start + len) after edits (pos, ref, alt) in order of pos, and (pos, length change) of the indels.

    Places shift by the indels strictly before them. A single-letter change writes the first letter of alt. The reference
    must stand where an edit is made, as it now is or, for indels, as it was; else the sequence is None. Deletes that
    reach over an end are cut at it.
    """
    out, shifts = sequence, []
    for pos, ref, alt in edits:
        at = pos - start + sum(s for p, s in shifts if p < pos)
        old = pos - start
        if len(ref) == len(alt):
            if not 0 <= at < len(out) or out[at] != ref[0]:
                return None, shifts
            out = out[:at] + alt[0] + out[at + 1 :]
        elif len(ref) < len(alt):
            if not 0 <= at < len(out) or out[at : at + len(ref)] != ref and sequence[old : old + len(ref)] != ref:
                return None, shifts
            out = out[: at + len(ref)] + alt[len(ref) :] + out[at + len(ref) :]
            shifts.append((pos, len(alt) - len(ref)))
        else:
            lo, up = at + len(alt), at + len(ref)
            cut_lo, cut_up = max(lo, 0), min(up, len(out))
            if cut_lo >= cut_up:
                return None, shifts
            want = ref[len(alt) + cut_lo - lo : len(alt) + cut_up - lo]
            if out[cut_lo:cut_up] != want and sequence[old + len(alt) + cut_lo - lo : old + len(alt) + cut_up - lo] != want:
                return None, shifts
            out = out[:cut_lo] + out[cut_up:]
            shifts.append((pos, -(cut_up - cut_lo)))
    return out, shifts


def mutate(variants: DataFrame, transcripts: DataFrame, contigs: DataFrame, how: str = "default", margin: int = 200) -> DataFrame:
    """Per genome and transcript that has variants: variants used, changed coding sequence, its protein's validity, and the length change.

    transcripts: transcript, contig_id, strand, exons (array of lower, upper). Variants that modify the span are joined by
    bins; the fold over a transcript's ordered variants runs per (genome, transcript). A failed edit gives a null sequence.
    """
    chosen = select(variants, how)
    t = transcripts.withColumn("exons", F.array_sort("exons"))
    t = t.withColumns({"lower": F.array_min(F.transform("exons", lambda x: x["lower"])), "upper": F.array_max(F.transform("exons", lambda x: x["upper"]))})
    m = chosen.withColumn("_m", V.modify_interval()).select("genome_id", "contig_id", "pos", "ref", "alt", F.col("_m.lower").alias("lo"), F.greatest("_m.upper", F.col("_m.lower") + 1).alias("up"))
    hit = interval_join(m, t.select("transcript", "contig_id", "lower", "upper"), ["contig_id"], ("lo", "up"), ("lower", "upper"), 128)
    hit = hit.groupBy("genome_id", "contig_id", F.col("r_transcript").alias("transcript")).agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alt"))).alias("edits"))
    t = reference_at(t, contigs, "lower", F.col("upper") - F.col("lower")).where("_reference IS NOT NULL").withColumnRenamed("_reference", "span")
    rows = hit.join(t, ["transcript", "contig_id"]).select("genome_id", "transcript", "strand", "lower", "exons", "edits", "span")

    def fold(batches):
        for b in batches:
            out = []
            for g, tr, strand, lower, exons, edits, text in zip(*(b[c] for c in ("genome_id", "transcript", "strand", "lower", "exons", "edits", "span")), strict=True):
                changed, shifts = apply_variants(text, lower, [(e["pos"], e["ref"], e["alt"]) for e in edits])
                if changed is None:
                    out.append((g, tr, strand, len(edits), None, 0))
                    continue
                move = lambda p, s=shifts: p - lower + sum(d for q, d in s if q < p)  # noqa: B023,E731
                out.append((g, tr, strand, len(edits), "".join(changed[max(move(x["lower"]), 0) : max(move(x["upper"]), 0)] for x in exons), sum(d for _, d in shifts)))
            yield pd.DataFrame(out, columns=["genome_id", "transcript", "strand", "variants", "linear", "shift"])

    done = rows.mapInPandas(fold, "genome_id string, transcript string, strand string, variants int, linear string, shift int")
    coding = S.stranded("linear", "strand")
    return done.select("genome_id", "transcript", "variants", coding.alias("coding"), F.when(F.col("linear").isNull(), "FAILED").otherwise(S.validity(coding)).alias("validity"), "shift")


def validity_tally(mutated: DataFrame) -> DataFrame:
    """Per transcript the genomes of each validity; failed ones apart."""
    codes = ("VALID", "NOT_MOD3", "NO_START", "NONSENSE", "NO_STOP", "FAILED")
    return mutated.groupBy("transcript").agg(F.count("*").alias("genomes"), F.sum("variants").alias("variants"), *[F.count_if(F.col("validity") == c).alias(c.lower()) for c in codes])


def transcript_families(mutated: DataFrame) -> DataFrame:
    """Distinct coding sequences of a transcript with their genomes, the largest first labelled 1."""
    from pyspark.sql import Window as W

    t = mutated.where("coding IS NOT NULL").groupBy("transcript", "coding").agg(F.count("*").alias("genomes"), F.min("genome_id").alias("first"))
    return t.withColumn("label", F.row_number().over(W.partitionBy("transcript").orderBy(F.col("genomes").desc(), "first")))


def mutate_regions(variants: DataFrame, regions: DataFrame, contigs: DataFrame, how: str = "default") -> DataFrame:
    """mutate over plain regions (region, contig_id, lower, upper): (genome_id, region, variants, sequence, shift); null where an edit fails."""
    t = regions.select(F.col("region").alias("transcript"), "contig_id", F.lit("+").alias("strand"), F.array(F.struct(F.col("lower").cast("long").alias("lower"), F.col("upper").cast("long").alias("upper"))).alias("exons"))
    return mutate(variants, t, contigs, how).select("genome_id", F.col("transcript").alias("region"), "variants", F.col("coding").alias("sequence"), "shift")


def family_distances(mutated: DataFrame, transcript: str) -> DataFrame:
    """(i, j, d) over the distinct sequences of one transcript, by label: edit distances for its family tree."""
    from .trees import edit

    f = transcript_families(mutated.where(F.col("transcript") == transcript))
    return edit(f.select("label", "coding"), "label", "coding")


def genome_distances(mutated: DataFrame) -> DataFrame:
    """(i, j, d) of genomes i > j: the share of transcripts, of those that both have, whose sequences differ."""
    t = mutated.select("transcript", "genome_id", F.coalesce("coding", F.lit("")).alias("coding"))
    a, b = t.withColumnsRenamed({"genome_id": "i", "coding": "x"}), t.withColumnsRenamed({"genome_id": "j", "coding": "y"})
    both = a.join(b, "transcript").where("i > j")  # genomes of a tree: a bounded set
    return both.groupBy("i", "j").agg(F.avg((F.col("x") != F.col("y")).cast("double")).alias("d"))
