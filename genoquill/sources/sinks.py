"""Reports: frames as CSV folders, texts that a driver writes, and appended tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(df: DataFrame, path: str, sep: str = ",", order: Sequence[str] = ()) -> None:
    """A CSV folder with headers; ordered within the whole if asked for."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def wide(df: DataFrame, by: Sequence[str], key: str, values: Sequence, columns: Sequence[str]) -> DataFrame:
    """One row per `by`, one column per value of key and column: the layout of bin and population reports."""
    return df.groupBy(*by).agg(*[F.sum(F.when(F.col(key) == v, F.col(c))).alias(f"{c}_{v}") for v in values for c in columns])


def append_citations(df: DataFrame, path: str) -> None:
    df.select("rsid", "pmid").write.mode("append").option("header", True).csv(path)


def cache_table(df: DataFrame, path: str) -> None:
    """New rows appended to a Parquet cache."""
    df.write.mode("append").parquet(path)


def matrix(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A square matrix (a, b, s) of named keys as tab-separated text, absent entries 0."""
    t = wide(df.withColumn("s", F.col("s").cast("double")), ["a"], "b", keys, ["s"]).fillna(0.0)
    t.toDF("a", *keys).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


#: Column titles of the gene report; fixed values.
GENE_TITLES = {"genome": "Genome", "contig_id": "Contig", "entrez": "Entrez_id", "hgnc": "HGNC_id", "ensembl": "Ensembl_id", "uniprot": "UniProtKB_id", "symbol": "Symbol_id", "description": "Description", "citations": "Citations", "biotype": "BioType", "valid_protein": "ValidProtein", "lower": "Begin", "upper": "End", "span": "Span", "strand": "Strand", "sequences": "Sequences", "sequence_name": "SeqName", "nucleotides": "Nucleotides", "exons": "Exons"}


def titled(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    """The columns that titles names, in its order and under its titles, then the others; arrays joined by &."""
    kinds = dict(df.dtypes)
    column = lambda c: F.array_join(c, "&") if kinds[c].startswith("array") else F.col(c)
    own = [column(c).alias(t) for c, t in titles.items() if c in kinds]
    return df.select(*own, *[column(c).alias(c) for c in df.columns if c not in titles])


def gene_mutation_report(df: DataFrame, path: str, sep: str = ",") -> None:
    report(titled(df, GENE_TITLES), path, sep)


def family_report(families: DataFrame, path: str) -> None:
    """Distinct sequences of transcripts as tab-separated text, the most frequent first."""
    report(families.select("transcript", "label", "genomes", "first", F.length("coding").alias("size"), "coding"), path, "\t", ("transcript", "label"))


def genome_report(profiles: DataFrame, path: str) -> None:
    report(profiles, path, "\t", ("genome_id",))


def validity_report(tally: DataFrame, path: str) -> None:
    report(tally, path, ",", ("transcript",))


def literature_report(publications: DataFrame, path: str) -> None:
    """A line of text per publication, the latest first."""
    from ..operators.literature import bibliography

    publications.orderBy(F.col("year").desc(), F.col("month").desc(), "pmid").select(bibliography().alias("value")).write.mode("overwrite").text(path)


def population_literature(alleles: DataFrame, carriers: DataFrame, path: str) -> None:
    """Cited alleles (rsid, genes, pmids, disease_pmids) by population (rsid, population, genomes) as CSV."""
    report(titled(alleles.join(carriers, "rsid", "left").fillna(0, ["genomes"]), {"rsid": "Allele", "population": "Population", "genomes": "Genomes"}), path, ",", ("Allele", "Population"))


def evidence(delimiter: str = "|", **columns: Column | str) -> Column:
    """Evidence on one line, as delimiter, name, colon and value of each column; missing values as No."""
    part = lambda n, c: F.concat(F.lit(f"{delimiter}{n}:"), F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("No")))
    return F.concat(*[part(n, c) for n, c in columns.items()])


def chain_files(samples: DataFrame, taxa: Sequence[str], path: str) -> None:
    """Samples of chains as NEXUS trees (path/trees) and tab-separated parameters (path/parameters), a row per sample."""
    block = "#nexus\n\nbegin taxa;\n  dimensions ntax=%d;\n  taxlabels %s;\nend;\n\nbegin trees;" % (len(taxa), " ".join(taxa))
    spark = samples.sparkSession
    ends = spark.createDataFrame([(0, -1, -1, block), (2, -1, -1, "end;")], "part int, chain long, step long, value string")
    trees = samples.select(F.lit(1).alias("part"), "chain", "step", F.concat(F.lit("  tree iter_"), F.col("step").cast("string"), F.lit(" = "), "tree").alias("value"))
    lines = ends.union(trees).coalesce(1).sortWithinPartitions("part", "chain", "step")  # chains write a bounded number of samples
    lines.select("value").write.mode("overwrite").text(f"{path}/trees")
    rows = samples.coalesce(1).sortWithinPartitions("chain", "step")
    flat = [F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.drop("tree").dtypes]
    report(rows.select(*flat), f"{path}/parameters", "\t")
