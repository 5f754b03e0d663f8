"""Readers of genomic, ontology and literature formats. Paths are whatever Spark reads; codecs go by extension."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_META = re.compile(r"^##(\w+)=(.*)$")
_PAIR = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines; .gz and .bz2 by extension. Block-gzip files named .bgz are read by bgzf_lines."""
    return spark.read.text(path)


def bgzf_blocks(data: bytes, chunk: int = 1 << 15) -> Iterator[bytes]:
    """The unpacked blocks of block-gzip bytes, fed chunk by chunk so that no block copies what is behind it; ValueError for a broken one."""
    view, at = memoryview(data), 0
    while at < len(view):
        if bytes(view[at : at + 4]) != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block")
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("truncated block")
            try:
                parts.append(unpack.decompress(view[at : at + chunk]))
            except zlib.error as e:
                raise ValueError("broken block") from e
            at = min(at + chunk, len(view))
        at -= len(unpack.unused_data)
        yield b"".join(parts)


def bgzf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of block-gzip files of any name: the blocks are gzip members, unpacked one by one; lines may span blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                left, out, size = b"", [], 0
                for text in bgzf_blocks(content.as_buffer()):
                    *whole, left = (left + text).split(b"\n")
                    out += whole
                    size += len(text)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], names=["value"])
                        out, size = [], 0
                if left:
                    out.append(left)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def bgzf_verify(data: bytes) -> dict:
    """Blocks, bytes and whether the end marker (an empty block) is there; ValueError for a broken block."""
    blocks = size = last = 0
    for text in bgzf_blocks(data):
        blocks, last = blocks + 1, len(text)
        size += last
    return {"blocks": blocks, "bytes": size, "end_marker": blocks > 0 and last == 0}


def vcf_header(spark: SparkSession, path: str) -> dict:
    """info (id -> number, type, description), contigs (id -> length) and samples of a header: lines go to the driver, partition by partition, up to the first record."""
    info, contigs, samples = {}, {}, []
    for row in lines(spark, path).toLocalIterator():
        if not row.value.startswith("#"):
            break  # the header stands in front of the records
        if row.value.startswith("#CHROM"):
            samples = row.value.split("\t")[9:]
        elif m := _META.match(row.value):
            pairs = {k: v.strip('"') for k, v in _PAIR.findall(m[2].strip("<>"))}
            if m[1] == "INFO":
                info[pairs["ID"]] = {"number": pairs.get("Number", "."), "type": pairs.get("Type", "String"), "description": pairs.get("Description", "")}
            elif m[1] == "contig":
                contigs[pairs["ID"]] = int(pairs.get("length", 0) or 0)
    return {"info": info, "contigs": contigs, "samples": samples}


def _known(x: Column) -> Column:
    return F.when((x == ".") | (x == ""), None).otherwise(x)


def vcf_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: contig_id, zero-based pos, identifier, ref, alt, qual, filter, pass, info (map), format, genotypes (array).

    Records of fewer than 8 fields or without a numeric position are left out.
    """
    v = F.split("value", "\t")
    t = lines(spark, path).where(~F.startswith("value", F.lit("#"))).select(v.alias("v")).where(F.size("v") >= 8)
    g = lambda i: F.get("v", F.lit(i))
    t = t.select(
        g(0).alias("contig_id"), (g(1).try_cast("long") - 1).alias("pos"), F.coalesce(_known(g(2)), F.lit("")).alias("identifier"), F.upper(g(3)).alias("ref"), F.upper(g(4)).alias("alt"),
        F.coalesce(g(5).try_cast("double"), F.lit(0.0)).alias("qual"), g(6).alias("filter"), (F.upper(g(6)) == "PASS").alias("pass"), info_map(g(7)).alias("info"), F.coalesce(g(8), F.lit("")).alias("format"),
        F.slice("v", F.lit(10), F.greatest(F.size("v") - 9, F.lit(0))).alias("genotypes"),
    )
    return t.where("pos IS NOT NULL")


def info_map(text: Column) -> Column:
    """key -> value of an INFO text; flags have an empty value, of repeated keys the first counts."""
    parts = F.filter(F.split(text, ";"), lambda x: (x != "") & (x != "."))
    pairs = F.transform(parts, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("v")))
    ordered = F.transform(F.array(F.array_sort(pairs)), lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["k"] != x["k"])))[0]  # equal keys are neighbours
    return F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))


def _numbers(raw: Column, kind: str) -> Column:
    return F.transform(F.split(raw, ","), lambda x: _known(x).try_cast(kind))


def typed_info(df: DataFrame, fields: dict[str, dict], wanted: list[str]) -> DataFrame:
    """df with a column per wanted INFO field, typed by the header: Flag boolean, Number 1 a scalar, others arrays.

    A scalar field of several values is null; a field that the header lacks is an error.
    """
    kinds = {"Integer": "bigint", "Float": "double"}
    out = {}
    for name in wanted:
        if name not in fields:
            raise KeyError(f"no INFO field {name}")
        f, raw = fields[name], F.try_element_at("info", F.lit(name))
        kind = kinds.get(f["type"], "string")
        values = _numbers(raw, kind)
        if f["type"] == "Flag":
            out[name] = F.coalesce(F.map_contains_key("info", name), F.lit(False))
        elif f["number"] == "1":
            out[name] = F.when(F.size(values) == 1, F.get(values, F.lit(0)))
        else:
            out[name] = values
    return df.withColumns(out)


def format_value(code: str, genotype: Column, form: Column | None = None) -> Column:
    """The value of a FORMAT code in a genotype text; null where the record lacks the code."""
    at = F.array_position(F.split(F.col("format") if form is None else form, ":"), code)
    return F.when(at > 0, F.get(F.split(genotype, ":"), (at - 1).cast("int")))


def genotype_variants(records: DataFrame, samples: list[str], phased: bool = True) -> DataFrame:
    """One row per sample, phase and alternate that the sample has: phase 1 and 2, or 255 if unphased; haploid genotypes phase 0."""
    names = F.array(*[F.lit(s) for s in samples])
    t = records.select("*", F.posexplode("genotypes").alias("_k", "_g"))
    t = t.withColumn("genome_id", F.get(names, F.col("_k"))).withColumn("_gt", F.split(format_value("GT", F.col("_g")), r"[|/]"))
    t = t.select("*", F.posexplode("_gt").alias("_p", "_a")).withColumn("_a", F.col("_a").try_cast("int")).where("_a > 0")
    phase = F.when(F.size("_gt") == 1, 0).otherwise(F.col("_p") + 1 if phased else F.lit(255))
    alts = F.split("alt", ",")
    t = t.withColumns({"phase": phase.cast("int"), "alt_index": F.col("_a") - 1, "alt_count": F.size(alts), "_alt": F.get(alts, F.col("_a") - 1)}).where("_alt IS NOT NULL")
    return t.drop("alt", "_k", "_gt", "_p", "_a", "genotypes").withColumnsRenamed({"_alt": "alt", "_g": "genotype"})


def single_genome(records: DataFrame, name: str) -> DataFrame:
    """One row per alternate, of one genome named name, without genotypes."""
    t = records.select("*", F.posexplode(F.split("alt", ",")).alias("alt_index", "_alt")).withColumn("alt_count", F.size(F.split("alt", ",")))
    return t.drop("alt", "genotypes").withColumnRenamed("_alt", "alt").withColumns({"genome_id": F.lit(name), "phase": F.lit(255)})


def falciparum(records: DataFrame, samples: list[str]) -> DataFrame:
    """genotype_variants of records with GT and AD, without upstream alleles (*) and genotypes without any depth; ref_count, alt_count, dp, gq."""
    code = F.split("format", ":")
    t = genotype_variants(records.where(F.array_contains(code, "GT") & F.array_contains(code, "AD")), samples, phased=True).where("alt <> '*'")
    ad = F.transform(F.split(format_value("AD", F.col("genotype")), ","), lambda x: x.try_cast("long"))
    t = t.withColumns({"ref_count": F.get(ad, F.lit(0)), "alt_count_reads": F.get(ad, F.col("alt_index") + 1), "dp": format_value("DP", F.col("genotype")).try_cast("long"), "gq": format_value("GQ", F.col("genotype")).try_cast("double")})
    return t.where("coalesce(ref_count, 0) + coalesce(alt_count_reads, 0) > 0")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, description, sequence) of FASTA files; records are split at > by the reader, so files stay splittable."""
    t = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    head = F.substring_index(F.substring_index("value", "\n", 1), "\r", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", ""))
    return t.select(F.substring_index(head, " ", 1).alias("contig_id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), body.alias("sequence"))


def write_fasta(df: DataFrame, path: str, width: int = 70) -> None:
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), "contig_id", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise(""), F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features with zero-based starts: contig_id, source, type, lower, upper, score, strand, phase, attributes (upper-case keys), feature_id, parents.

    Rows of other widths or bounds are left out; a missing phase is 0, a CDS of another phase than 0, 1 or 2 is left out;
    missing ids become type and start.
    """
    v = F.split("value", "\t")
    t = lines(spark, path).where(~F.startswith("value", F.lit("#"))).select(v.alias("v")).where("size(v) = 9")
    g = lambda i: F.get("v", F.lit(i))
    pairs = F.filter(F.split(g(8), ";"), lambda x: F.contains(x, F.lit("=")))
    attributes = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.upper(F.trim(F.substring_index(p, "=", 1))).alias("key"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("value"))))
    phase = F.when(g(7).isin(".", ""), 0).otherwise(g(7).try_cast("int"))
    t = t.select(g(0).alias("contig_id"), g(1).alias("source"), F.upper(g(2)).alias("type"), (g(3).try_cast("long") - 1).alias("lower"), g(4).try_cast("long").alias("upper"), g(5).try_cast("double").alias("score"), g(6).alias("strand"), phase.alias("phase"), attributes.alias("attributes"))
    t = t.where("lower >= 0 AND upper > lower").where("type <> 'CDS' OR phase BETWEEN 0 AND 2")
    return t.withColumns({"feature_id": F.coalesce(F.try_element_at("attributes", F.lit("ID")), F.concat("type", F.col("lower").cast("string"))), "parents": F.split(F.coalesce(F.try_element_at("attributes", F.lit("PARENT")), F.lit("")), ",")})


def flat(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", comment: str = "#", header: bool | None = None) -> DataFrame:
    """Delimited text without comment lines; with names for all columns, or by the first row. Rows of another width fail on read."""
    reader = spark.read.option("sep", sep).option("comment", comment).option("mode", "FAILFAST")
    if columns is None or header:
        return reader.option("header", True).csv(path)
    return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """df, or ValueError if a key occurs twice."""
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} isn't unique")
    return df


def pf7_samples(spark: SparkSession, path: str) -> DataFrame:
    t = unique_key(flat(spark, path, sep="\t"), "Sample")
    return t.withColumn("qc_pass", F.upper(F.trim("QC pass")) == "TRUE").withColumnRenamed("Sample", "genome_id")


def pf7_fws(spark: SparkSession, path: str) -> DataFrame:
    """(genome_id, fws); text that isn't a number is null."""
    t = flat(spark, path, sep="\t")
    a, b = t.columns[:2]
    return t.select(F.col(a).alias("genome_id"), F.col(b).try_cast("double").alias("fws"))


def pf7_distances(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """(i, j, d) of a square matrix written row by row, one number a line; nan, negative and other text are null.

    Line numbers come from the order of partitions and the lines before them, counted once.
    """
    t = lines(spark, path).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    before, total = {}, 0
    for r in t.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("m")).orderBy("_p").collect():  # a row per partition
        before[r["_p"]], total = total - r["m"], total + r["n"]
    if total != len(samples) ** 2:
        raise ValueError(f"{total} lines for {len(samples)} samples")
    shift = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map()
    k, n, names = F.col("_m") + F.element_at(shift, F.col("_p")), len(samples), F.array(*[F.lit(s) for s in samples])
    d = F.trim("value").try_cast("double")
    return t.select(F.get(names, F.floor(k / n).cast("int")).alias("i"), F.get(names, F.pmod(k, F.lit(n)).cast("int")).alias("j"), F.when(~F.isnan(d) & (d >= 0), d).alias("d"))


def citations_json(spark: SparkSession, path: str) -> DataFrame:
    """(rsid, pmid) of line-JSON with refsnp_id and citations; of repeated ids one record counts, empty lists are left out."""
    t = spark.read.schema("refsnp_id string, citations array<bigint>").json(path).where("refsnp_id IS NOT NULL AND size(citations) > 0")
    return t.dropDuplicates(["refsnp_id"]).select(F.concat(F.lit("rs"), "refsnp_id").alias("rsid"), F.explode(F.array_distinct("citations")).alias("pmid"))


def allele_citations(spark: SparkSession, path: str) -> DataFrame:
    return flat(spark, path, ["rsid", "pmid"]).distinct()


def bio_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Disease and Gene rows of (pmid, type, id, text, resource)."""
    return flat(spark, path, ["pmid", "type", "concept_id", "text", "resource"], sep="\t").where(F.col("type").isin("Disease", "Gene"))


#: Columns of fixed-width records; fixed values.
GAF_COLUMNS = ["database", "gene", "symbol", "qualifier", "term", "reference", "evidence", "with_from", "ontology", "name", "synonym", "kind", "taxon", "date", "assigned_by", "extension", "product"]
ENTREZ_COLUMNS = ["taxon", "entrez", "symbol", "locus_tag", "synonyms", "dbxrefs", "chromosome", "map_location", "description", "type", "symbol_authority", "name_authority", "status", "other", "modified", "feature_type"]
PED_COLUMNS = ["family", "individual", "paternal", "maternal", "sex", "phenotype", "population", "relationship"]
AUX_COLUMNS = ["individual", "sex", "population", "population_text", "super_population", "super_population_text"]


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """17 fields; rows whose ontology letter isn't P, F or C are left out."""
    return flat(spark, path, GAF_COLUMNS, sep="\t", comment="!").where(F.col("ontology").isin("P", "F", "C"))


def entrez(spark: SparkSession, path: str) -> DataFrame:
    return flat(spark, path, ENTREZ_COLUMNS, sep="\t")


def ensembl_hgnc(spark: SparkSession, path: str) -> DataFrame:
    """(hgnc, canonical ids first): the Ensembl ids of each HGNC id."""
    t = flat(spark, path, ["ensembl", "canonical", "hgnc"], sep="\t").where("hgnc <> ''")
    return t.groupBy("hgnc").agg(F.transform(F.sort_array(F.collect_set(F.struct((F.col("canonical") != "1").alias("c"), "ensembl"))), lambda x: x["ensembl"]).alias("ensembl_ids"))


def uniprot(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(accession, one column of values per field) from (accession, field, value) lines."""
    t = flat(spark, path, ["accession", "field", "value"], sep="\t")
    return t.groupBy("accession").pivot("field", fields).agg(F.sort_array(F.collect_set("value")))


def genealogy(spark: SparkSession, path: str) -> DataFrame:
    return flat(spark, path, PED_COLUMNS, sep="\t")


def people(spark: SparkSession, path: str) -> DataFrame:
    return flat(spark, path, AUX_COLUMNS, sep="\t")


def coi(spark: SparkSession, path: str) -> DataFrame:
    t = flat(spark, path, sep="\t")
    return t.withColumnRenamed(t.columns[0], "genome_id")


RELATIONS = ("is_a", "part_of", "regulates", "positively_regulates", "negatively_regulates")


def obo(spark: SparkSession, path: str, relations: tuple[str, ...] = RELATIONS) -> tuple[DataFrame, DataFrame]:
    """terms (term, name, ontology, definition) and edges (child, parent, relation) of an OBO file.

    Stanzas are split at blank lines; obsolete ones, those of an unknown namespace and those without an id go, and so do terms
    without an edge of the relations that aren't roots. A last stanza without a blank line behind it counts like others.
    """
    t = spark.read.text(path, lineSep="\n\n").where(F.startswith(F.ltrim("value"), F.lit("[Term]")))
    field = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    t = t.select(field("id").alias("term"), field("name").alias("name"), field("namespace").alias("ontology"), field("def").alias("definition"), (F.coalesce(field("is_obsolete"), F.lit("false")) == "true").alias("_old"), F.col("value"))
    t = t.where("term IS NOT NULL AND NOT _old").where(F.col("ontology").isin("biological_process", "molecular_function", "cellular_component"))
    isa = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^is_a:[ \t]*(\S+)"), 1), lambda p: F.struct(p.alias("parent"), F.lit("is_a").alias("relation")))
    other = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^relationship:[ \t]*(\S+[ \t]+\S+)"), 1), lambda p: F.struct(F.regexp_extract(p, r"(\S+)$", 1).alias("parent"), F.regexp_extract(p, r"^(\S+)", 1).alias("relation")))
    edges = t.select(F.col("term").alias("child"), F.explode(F.concat(isa, other)).alias("e")).select("child", "e.parent", "e.relation").where(F.col("relation").isin(list(relations)))
    linked = edges.select(F.col("child").alias("term")).union(edges.select(F.col("parent").alias("term"))).distinct()
    return t.select("term", "name", "ontology", "definition").join(linked, "term", "left_semi"), edges


def obo_xml(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an obo-xml file: term, name, ontology, parents."""
    t = spark.read.schema("id string, name string, namespace string, is_a array<string>, is_obsolete string").option("rowTag", "term").xml(path)
    return t.where("id IS NOT NULL AND coalesce(is_obsolete, '0') <> '1'").select(F.col("id").alias("term"), "name", F.col("namespace").alias("ontology"), F.coalesce("is_a", F.array().cast("array<string>")).alias("parents"))


def publications_xml(spark: SparkSession, path: str) -> DataFrame:
    """Publications of PubMed article sets: pmid, title, abstract, journal, year, authors, mesh."""
    schema = "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string>>>, Abstract: struct<AbstractText: array<string>>, AuthorList: struct<Author: array<struct<LastName: string, Initials: string>>>>, MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: string>>>>"
    t = spark.read.schema(schema).option("rowTag", "PubmedArticle").xml(path).select("MedlineCitation.*")
    a = lambda x: F.col(f"Article.{x}")
    return t.select(F.col("PMID").alias("pmid"), a("ArticleTitle").alias("title"), F.array_join(a("Abstract.AbstractText"), " ").alias("abstract"), a("Journal.Title").alias("journal"), a("Journal.JournalIssue.PubDate.Year").try_cast("int").alias("year"), a("AuthorList.Author").alias("authors"), F.transform(F.col("MeshHeadingList.MeshHeading"), lambda m: m["DescriptorName"]).alias("mesh"))


def similarity_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, s) of a matrix file whose first row and column are term ids."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    first, *others = t.columns
    return t.select(F.col(first).alias("a"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[F.col(f"`{c}`").try_cast("double") for c in others]))).alias("b", "s"))


def nexus(text: str) -> dict:
    """taxa, characters (taxon -> states) and trees (name -> Newick) of a NEXUS text."""
    out: dict = {"taxa": [], "characters": {}, "trees": {}}
    text = re.sub(r"\[[^\]]*\]", "", text)
    if m := re.search(r"(?is)taxlabels(.*?);", text):
        out["taxa"] = m[1].split()
    if m := re.search(r"(?is)matrix(.*?);", text):
        for line in m[1].strip().splitlines():
            name, *states = line.split()
            out["characters"][name] = out["characters"].get(name, "") + "".join(states)
    for name, tree in re.findall(r"(?im)^\s*u?tree\s+\*?\s*(\S+)\s*=\s*(.*?;)", text):
        out["trees"][name] = tree.strip()
    return out


def file_names(spark: SparkSession, *paths: str) -> DataFrame:
    """(path) of files that are passed on by name only."""
    return spark.createDataFrame([(p,) for p in paths], "path string")


def dbsnp(records: DataFrame, name: str, accept: Column | None = None) -> DataFrame:
    """single_genome of the records that a caller's condition accepts; all without one."""
    return single_genome(records if accept is None else records.where(accept), name)


def genome(spark: SparkSession, fasta_path: str, gff_path: str) -> tuple[DataFrame, DataFrame]:
    """contigs (contig_id, description, sequence, length) and features cut to them; features of unknown contigs are left out."""
    from ..operators.features import clamp

    contigs = fasta(spark, fasta_path).withColumn("length", F.length("sequence").cast("long"))
    return contigs, clamp(gff3(spark, gff_path), contigs)


def sample_attributes(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Samples with a column per attribute, names in upper case; rows of another width than the header's and repeated samples are left out."""
    t = spark.read.text(path).where(F.trim("value") != "")
    first = t.first()
    if first is None:
        raise ValueError("no header")
    names = [x.strip().upper() for x in first.value.split(sep)]
    v = F.split("value", re.escape(sep), -1)
    t = t.where(F.col("value") != first.value).select(v.alias("v")).where(F.size("v") == len(names))
    return t.select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)]).dropDuplicates([names[0]])


def samples_with(attributes: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Samples whose attribute is one of the values, such as those of a country, or field and preferred samples."""
    return attributes.where(F.upper(F.trim(column)).isin([v.upper() for v in values])).select(attributes.columns[0])


def checked_obo(spark: SparkSession, path: str, relations: tuple[str, ...] = RELATIONS) -> tuple[DataFrame, DataFrame]:
    """obo of a file that begins with its format version; ValueError for others."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is None or not first.value.startswith("format-version:"):
        raise ValueError(f"{path} is no OBO file")
    return obo(spark, path, relations)


def property_lines(path: str, _open: tuple[str, ...] = ()) -> list[str]:
    """The lines of an XML file with `#include "file"` lines replaced by that file's, relative to its folder; lines that begin with // go."""
    import os

    path = os.path.abspath(path)
    if path in _open:
        raise ValueError(f"{path} includes itself")
    out: list[str] = []
    with open(path, encoding="utf-8") as f:
        for line in f.read().split("\n"):
            if line.startswith("//"):
                continue
            if line.startswith("#include"):
                out += property_lines(os.path.join(os.path.dirname(path), line.removeprefix("#include").strip().strip('"')), (*_open, path))
            else:
                out.append(line)
    return out


def properties(path: str) -> dict:
    """A settings file (XML with includes, or JSON) as nested dicts; repeated tags become lists, leaves are texts. Read on the driver."""
    import json
    from xml.etree import ElementTree

    if path.lower().endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def value(node):
        if not len(node):
            return (node.text or "").strip()
        out: dict = {}
        for child in node:
            got = value(child)
            if child.tag not in out:
                out[child.tag] = got
            elif isinstance(out[child.tag], list):
                out[child.tag].append(got)
            else:
                out[child.tag] = [out[child.tag], got]
        return out

    root = ElementTree.fromstring("\n".join(property_lines(path)))
    return {root.tag: value(root)}


def request(url: str, body: bytes | None = None, allowed: bool = False, timeout: float = 30.0) -> bytes:
    """The answer to one GET, or POST with a body, from the driver. Off unless allowed."""
    from urllib import request as web

    if not allowed:
        raise PermissionError("requests are off")
    with web.urlopen(web.Request(url, data=body), timeout=timeout) as answer:
        return answer.read()


def missing_from(cache: DataFrame, wanted: DataFrame, key: str = "pmid") -> DataFrame:
    """Keys that a cached table lacks."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


READERS: dict[str, Callable] = {
    "text": lines, "bgzf": bgzf_lines, "vcf": vcf_records, "fasta": fasta, "gff3": gff3, "flat": flat, "pf7_samples": pf7_samples, "pf7_fws": pf7_fws, "pf7_distances": pf7_distances, "citations_json": citations_json,
    "allele_citations": allele_citations, "bio_concepts": bio_concepts, "gaf": gaf, "entrez": entrez, "ensembl_hgnc": ensembl_hgnc, "uniprot": uniprot, "genealogy": genealogy, "people": people, "coi": coi,
    "obo": obo, "checked_obo": checked_obo, "obo_xml": obo_xml, "sample_attributes": sample_attributes, "file_names": file_names, "publications_xml": publications_xml, "similarity_matrix": similarity_matrix,
}


def read(spark: SparkSession, kind: str, path: str, **options):
    """A source by its type text."""
    if kind not in READERS:
        raise KeyError(f"no source type {kind}")
    return READERS[kind](spark, path, **options)
