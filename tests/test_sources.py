import gzip

import pytest
from pyspark.sql import functions as F

from genoquill.sources import formats as R

VCF = """##fileformat=VCFv4.2
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency, of alternates">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">
##contig=<ID=c1,length=100>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
c1\t10\trs1\tA\tC,G\t50\tPASS\tAF=0.1,0.2;DB;DP=7\tGT:AD:DP\t0|1:3,4,0:7\t2|1:0,2,5:7
c1\t20\t.\tAT\tA\t.\tq10\tDP=1,2\tGT:AD\t0|0:9,0\t0|1:0,0
bad line
"""


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_vcf(spark, tmp_path):
    path = put(tmp_path, "a.vcf", VCF)
    h = R.vcf_header(spark, path)
    assert h["samples"] == ["S1", "S2"] and h["contigs"] == {"c1": 100} and h["info"]["AF"]["description"] == "Frequency, of alternates"
    t = R.vcf_records(spark, path)
    rows = sorted(R.typed_info(t, h["info"], ["AF", "DB", "DP"]).collect(), key=lambda r: r.pos)
    assert [(r.pos, r.identifier, r["pass"], r.AF, r.DB, r.DP) for r in rows] == [(9, "rs1", True, [0.1, 0.2], True, 7), (19, "", False, None, False, None)]
    v = sorted((r.genome_id, r.pos, r.phase, r.alt) for r in R.genotype_variants(t, h["samples"]).collect())
    assert v == [("S1", 9, 2, "C"), ("S2", 9, 1, "G"), ("S2", 9, 2, "C"), ("S2", 19, 2, "A")]
    f = sorted((r.genome_id, r.pos, r.alt, r.alt_count_reads) for r in R.falciparum(t, h["samples"]).collect())
    assert f == [("S1", 9, "C", 4), ("S2", 9, "C", 2), ("S2", 9, "G", 5)]
    assert R.single_genome(t, "ref").count() == 3


def test_fasta_and_gff(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">c1 first contig\nacgt\nAC\n>c2\nTTT\n")
    rows = {r.contig_id: (r.description, r.sequence) for r in R.fasta(spark, path).collect()}
    assert rows == {"c1": ("first contig", "ACGTAC"), "c2": ("", "TTT")}
    R.write_fasta(R.fasta(spark, path), str(tmp_path / "out"), 4)
    assert {r.contig_id: (r.description, r.sequence) for r in R.fasta(spark, str(tmp_path / "out")).collect()} == rows
    g = put(tmp_path, "a.gff", "##gff-version 3\nc1\tx\tgene\t1\t9\t.\t+\t.\tID=g1;Name=n\nc1\tx\tCDS\t1\t3\t.\t+\t7\tParent=m1\nc1\tx\texon\t4\t6\t.\t-\t.\tParent=m1,m2\n")
    f = sorted((r.type, r.lower, r.upper, r.phase, r.feature_id, r.parents) for r in R.gff3(spark, g).collect())
    assert f == [("EXON", 3, 6, 0, "EXON3", ["m1", "m2"]), ("GENE", 0, 9, 0, "g1", [""])]


def test_block_gzip(spark, tmp_path):
    def block(data):
        raw = gzip.compress(data)
        return b"\x1f\x8b\x08\x04" + raw[4:10] + b"\x06\x00BC\x02\x00\x00\x00" + raw[10:]

    data = block(b"one\ntw") + block(b"o\nthree") + block(b"")
    (tmp_path / "a.bgz").write_bytes(data)
    assert [r.value for r in R.bgzf_lines(spark, str(tmp_path / "a.bgz")).collect()] == ["one", "two", "three"]
    assert R.bgzf_verify(data) == {"blocks": 3, "bytes": 13, "end_marker": True}
    with pytest.raises(ValueError):
        R.bgzf_verify(data[:-30] + b"x" * 30)


def test_ontology_and_tables(spark, tmp_path):
    o = put(tmp_path, "a.obo", "format-version: 1.2\n\n[Term]\nid: T:1\nname: root\nnamespace: biological_process\n\n[Term]\nid: T:2\nname: kid\nnamespace: biological_process\nis_a: T:1 ! root\nrelationship: part_of T:1 ! root\n\n[Term]\nid: T:3\nname: old\nnamespace: biological_process\nis_a: T:1\nis_obsolete: true\n\n[Term]\nid: T:4\nname: alone\nnamespace: biological_process\n")
    terms, edges = R.obo(spark, o)
    assert sorted(r.term for r in terms.collect()) == ["T:1", "T:2"]
    assert sorted(tuple(r) for r in edges.collect()) == [("T:2", "T:1", "is_a"), ("T:2", "T:1", "part_of")]
    g = put(tmp_path, "a.gaf", "!gaf\n" + "\t".join(["DB", "g1", "s", "", "T:2", "r", "IEA", "", "P", *[""] * 8]) + "\n" + "\t".join(["DB", "g1", "s", "", "T:2", "r", "IEA", "", "Z", *[""] * 8]) + "\n")
    assert [(r.gene, r.term, r.evidence) for r in R.gaf(spark, g).collect()] == [("g1", "T:2", "IEA")]
    d = put(tmp_path, "d.txt", "0\n1.5\nnan\n-2\n")
    assert sorted((r.i, r.j, r.d) for r in R.pf7_distances(spark, d, ["a", "b"]).collect() if r.d is not None) == [("a", "a", 0.0), ("a", "b", 1.5)]
    j = put(tmp_path, "c.json", '{"refsnp_id": "5", "citations": [1, 2, 2]}\n{"refsnp_id": "6", "citations": []}\n')
    assert sorted(tuple(r) for r in R.citations_json(spark, j).collect()) == [("rs5", 1), ("rs5", 2)]
    x = put(tmp_path, "p.xml", "<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle></S>")
    assert [(r.pmid, r.title, r.journal, r.year) for r in R.publications_xml(spark, x).collect()] == [("7", "T", "J", 2001)]
    n = R.nexus("#NEXUS\nbegin taxa; taxlabels A B; end;\nbegin data; matrix\nA ACGT\nB AC-T\n; end;\nbegin trees;\ntree t1 = (A:1,B:2);\nend;")
    assert n["taxa"] == ["A", "B"] and n["characters"]["B"] == "AC-T" and n["trees"] == {"t1": "(A:1,B:2);"}
    m = put(tmp_path, "m.tsv", "x\tT1\tT2\nT1\t1\t0.5\nT2\t0.5\t1\n")
    assert R.similarity_matrix(spark, m).count() == 4
    with pytest.raises(KeyError):
        R.read(spark, "nothing", m)


def test_settings_with_includes(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.xml").write_text("<item><name>two</name></item>\n//<item/>\n")
    put(tmp_path, "a.xml", '<run>\n<item><name>one</name></item>\n#include "sub/b.xml"\n//#include "none.xml"\n<size> 7 </size>\n</run>\n')
    assert R.properties(str(tmp_path / "a.xml")) == {"run": {"item": [{"name": "one"}, {"name": "two"}], "size": "7"}}
    put(tmp_path, "c.xml", '#include "c.xml"\n')
    with pytest.raises(ValueError):
        R.properties(str(tmp_path / "c.xml"))
    put(tmp_path, "s.json", '{"a": {"b": 1}}')
    assert R.properties(str(tmp_path / "s.json")) == {"a": {"b": 1}}
    with pytest.raises(PermissionError):
        R.request("http://localhost/")


def test_attributes_and_genome(spark, tmp_path):
    a = put(tmp_path, "aux.tsv", "sample\tCountry \tField\ns1\tGhana\tTRUE\ns2\tMali\tFALSE\ns2\tMali\tFALSE\nbad\n")
    t = R.sample_attributes(spark, a)
    assert t.columns == ["SAMPLE", "COUNTRY", "FIELD"] and t.count() == 2
    assert [r.SAMPLE for r in R.samples_with(t, "COUNTRY", ["ghana"]).collect()] == ["s1"]
    fa, gf = put(tmp_path, "g.fa", ">c1\nACGTAC\n"), put(tmp_path, "g.gff", "c1\tx\tgene\t3\t90\t.\t+\t.\tID=g\nc9\tx\tgene\t2\t90\t.\t+\t.\tID=h\n")
    contigs, features = R.genome(spark, fa, gf)
    assert [(r.contig_id, r.length) for r in contigs.collect()] == [("c1", 6)]
    assert [(r.feature_id, r.lower, r.upper) for r in features.collect()] == [("g", 2, 6)]
    o = put(tmp_path, "x.obo", "[Term]\nid: T:1\n")
    with pytest.raises(ValueError):
        R.checked_obo(spark, o)
    assert [r.path for r in R.file_names(spark, "a", "b").collect()] == ["a", "b"]


def test_report_layouts(spark, tmp_path):
    from genoquill.operators import filters
    from genoquill.sources import sinks

    df = spark.createDataFrame([("c", "g1", 3, ["E1", "E2"], 9)], "contig_id string, symbol string, span int, ensembl array<string>, extra int")
    sinks.gene_mutation_report(df, str(tmp_path / "genes"))
    r = spark.read.option("header", True).csv(str(tmp_path / "genes"))
    assert r.columns == ["Contig", "Ensembl_id", "Symbol_id", "Span", "extra"] and r.first().Ensembl_id == "E1&E2"
    line = df.select(sinks.evidence("|", Span="span", Other=F.lit(None)).alias("x")).first().x
    assert line == "|Span:3|Other:No"
    assert df.where(filters.variant_only("homozygous_offsets")).count() == 0 and df.where(filters.variant_only(F.col("span") == 3)).count() == 1
