"""Row-level expressions on a variant's reference text, alternate text, zero-based position and phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hgvs(contig="contig_id", pos="pos", ref="ref", alt="alt") -> Column:
    """contig:g.POSREF>ALT, the identity of a variant without its phase."""
    return F.concat(_c(contig), F.lit(":g."), _c(pos).cast("string"), _c(ref), F.lit(">"), _c(alt))


def hgvs_phase(contig="contig_id", pos="pos", ref="ref", alt="alt", phase="phase") -> Column:
    return F.concat(hgvs(contig, pos, ref, alt), F.lit(":"), _c(phase).cast("string"))


def mismatches(ref="ref", alt="alt") -> Column:
    """Places at which two texts of equal length differ."""
    r, a = _c(ref), _c(alt)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(r), F.lit(1))), F.lit(0), lambda n, i: n + F.when(F.substring(r, i, F.lit(1)) != F.substring(a, i, F.lit(1)), 1).otherwise(0))


def is_snp(ref="ref", alt="alt") -> Column:
    """One letter each, or equal lengths with one difference at most; equal texts count as SNP."""
    r, a = _c(ref), _c(alt)
    one = (F.length(r) == 1) & (F.length(a) == 1)
    return F.when(one, True).when(F.length(r) != F.length(a), False).otherwise(mismatches(r, a) <= 1)


def variant_type(ref="ref", alt="alt") -> Column:
    """SNP, INSERT or DELETE; equal lengths with several differences are DELETE."""
    r, a = _c(ref), _c(alt)
    return F.when(is_snp(r, a), "SNP").when(F.length(r) < F.length(a), "INSERT").otherwise("DELETE")


def is_canonical(ref="ref", alt="alt") -> Column:
    """1X, 1MnD or 1MnI: the shorter text has one letter."""
    return F.least(F.length(_c(ref)), F.length(_c(alt))) == 1


def _run(r: Column, a: Column, at) -> Column:
    """Length of the common run of r and a where at(text, i) is the i-th letter to compare."""
    n = F.least(F.length(r), F.length(a))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (i <= n) & (at(r, i) == at(a, i)), i).otherwise(k))


def common_prefix(ref="ref", alt="alt") -> Column:
    return _run(_c(ref), _c(alt), lambda t, i: F.substring(t, i, F.lit(1)))


def common_suffix(ref="ref", alt="alt") -> Column:
    return _run(_c(ref), _c(alt), lambda t, i: F.substring(t, F.length(t) - i + 1, F.lit(1)))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def canonical(ref="ref", alt="alt", pos="pos") -> Column:
    """struct(ref, alt, pos) with the common prefix but for one letter, and the common suffix, cut off."""
    r, a, p = _c(ref), _c(alt), _c(pos)
    cut = F.greatest(common_prefix(r, a) - 1, F.lit(0))

    def trimmed(c: Column) -> Column:
        tail = F.greatest(F.least(F.least(F.length(r), F.length(a)) - c["cut"] - 1, c["suffix"]), F.lit(0))
        kept = lambda t, k: F.substring(t, c["cut"] + 1, F.length(t) - c["cut"] - k)
        return _let(tail, lambda k: F.struct(kept(r, k).alias("ref"), kept(a, k).alias("alt"), (p + c["cut"]).cast("long").alias("pos")))

    same = F.struct(r.alias("ref"), a.alias("alt"), p.cast("long").alias("pos"))
    return F.when(is_canonical(r, a), same).otherwise(_let(F.struct(cut.alias("cut"), common_suffix(r, a).alias("suffix")), trimmed))


def with_canonical(df: DataFrame, ref: str = "ref", alt: str = "alt", pos: str = "pos") -> DataFrame:
    """df with ref, alt and pos in canonical form."""
    return df.withColumn("_canon", canonical(ref, alt, pos)).withColumns({ref: F.col("_canon.ref"), alt: F.col("_canon.alt"), pos: F.col("_canon.pos")}).drop("_canon")


def modify_interval(ref="ref", alt="alt", pos="pos") -> Column:
    """struct(kind, lower, upper): the type of a variant and the places that it changes; indels start behind their anchor."""

    def bounds(x: Column) -> Column:
        r, a, p, kind = F.length(x["c"]["ref"]), F.length(x["c"]["alt"]), x["c"]["pos"], x["kind"]
        lower = F.when(kind == "INSERT", p + r).when(kind == "DELETE", p + a).otherwise(p)
        size = F.when(kind == "INSERT", a - r).when(kind == "DELETE", r - a).otherwise(r)
        return F.struct(kind.alias("kind"), lower.cast("long").alias("lower"), (lower + size).cast("long").alias("upper"))

    return _let(F.struct(canonical(ref, alt, pos).alias("c"), variant_type(ref, alt).alias("kind")), bounds)


def member_interval(ref="ref", alt="alt", pos="pos") -> Column:
    """modify_interval, with that of an insert narrowed to the two places around its start."""
    return _let(modify_interval(ref, alt, pos), lambda m: F.when(m["kind"] == "INSERT", F.struct(m["kind"].alias("kind"), (m["lower"] - 1).alias("lower"), (m["lower"] + 1).alias("upper"))).otherwise(m))


def is_transition(ref="ref", alt="alt") -> Column:
    """A and G, or C and T, exchanged."""
    return F.concat(F.least(_c(ref), _c(alt)), F.greatest(_c(ref), _c(alt))).isin("AG", "CT")


def is_frameshift(ref="ref", alt="alt") -> Column:
    return ~is_snp(ref, alt) & (F.abs(F.length(_c(ref)) - F.length(_c(alt))) % 3 != 0)


def phred_probability(q) -> Column:
    return F.pow(F.lit(10.0), _c(q) / F.lit(-10.0))


def info_number(values, alt_index, alt_count) -> Column:
    """Of an INFO array the value for one alternate: the only one, or that at alt_index of alt_count; NULL for other widths."""
    v, n = _c(values), F.size(_c(values))
    return F.when(n == 1, F.get(v, F.lit(0))).when(n == _c(alt_count), F.get(v, _c(alt_index))).otherwise(F.lit(None))


def histogram(text, bins: int) -> Column:
    """Numbers of a |-separated histogram; NULL for another number of bins."""
    parts = F.split(_c(text), r"\|")
    return F.when(F.size(parts) == bins, F.transform(parts, lambda x: x.try_cast("double"))).otherwise(F.lit(None))


def vep_records(text, fields: list[str]) -> Column:
    """Array of structs of a VEP field: records by comma, fields by |; records of another width are left out."""
    records = F.filter(F.transform(F.split(_c(text), ","), lambda r: F.split(r, r"\|", -1)), lambda r: F.size(r) == len(fields))
    return F.transform(records, lambda r: F.struct(*[r[i].alias(n) for i, n in enumerate(fields)]))


#: Frequency fields of the super-populations by source; fixed values.
SUPER_POPULATION_FIELDS = {
    "1000G": {"AFR": "AFR_AF", "AMR": "AMR_AF", "EAS": "EAS_AF", "EUR": "EUR_AF", "SAS": "SAS_AF", "ALL": "AF"},
    "GNOMAD": {"AFR": "AF_afr", "AMR": "AF_amr", "EAS": "AF_eas", "EUR": "AF_nfe", "SAS": "AF_sas", "ALL": "AF"},
}


def super_population_field(source: str, population: str) -> str | None:
    return SUPER_POPULATION_FIELDS.get(source, {}).get(population)


def same_variant(a: dict[str, Column], b: dict[str, Column], mode: str) -> Column:
    """phased, unphased (analogous), homozygous (analogous in another phase) or less (by phased text)."""
    ha, hb = (hgvs(x["contig_id"], x["pos"], x["ref"], x["alt"]) for x in (a, b))
    pa, pb = (hgvs_phase(x["contig_id"], x["pos"], x["ref"], x["alt"], x["phase"]) for x in (a, b))
    return {"phased": pa == pb, "unphased": ha == hb, "analogous": ha == hb, "homozygous": (ha == hb) & (a["phase"] != b["phase"]), "less": pa < pb}[mode]
