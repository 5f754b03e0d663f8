import pytest
from pyspark.sql import functions as F

from genoquill.operators import features as X
from genoquill.plans import packages
from genoquill.plans.fixtures import frame
from genoquill.sources import sinks
from genoquill.streaming.windows import tumbling_counts

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["interval", "info_filter", "inbreeding", "pfemp", "mutation", "literature"])
def test_reports_have_rows(spark, name):
    sources = {k: frame(spark, D, k) for k in ("variants", "samples", "genes", "publications", "citations")}
    out = packages.run(name, sources, {"interval_size": "50", "fws": "0.3"})
    assert out and all(df.limit(1).count() for df in out.values())


def test_features(spark):
    rows = [("g1", "GENE", 0, 12, []), ("m1", "MRNA", 0, 12, ["g1"]), ("c1", "CDS", 0, 6, ["m1"]), ("c2", "CDS", 9, 12, ["m1"]), ("e1", "EXON", 0, 12, ["m1", "zz"]), ("x", "EXON", 5, 20, ["m1"])]
    f = spark.createDataFrame([(i, "c", k, lo, up, "+", p) for i, k, lo, up, p in rows], "feature_id string, contig_id string, type string, lower long, upper long, strand string, parents array<string>")
    edges = X.hierarchy(f)
    assert edges.count() == 5
    assert [r.child for r in X.misplaced(f, edges).collect()] == ["x"]
    t = X.bounds(X.transcripts(f, edges)).collect()
    assert [(r.gene_id, r.transcript, r.kind, r.start, r.end, r.coding_length) for r in t] == [("g1", "m1", "PROTEIN", 0, 12, 9)]
    contigs = spark.createDataFrame([("c", "ATGAAACCCTAAGGGG", 16)], "contig_id string, sequence string, length long")
    s = X.coding_sequences(X.transcripts(f, edges), contigs).first()
    assert (s.coding, s.protein, s.validity) == ("ATGAAATAA", "MK*", "VALID")
    assert X.equivalent(f, f.orderBy("lower")) and not X.equivalent(f, f.limit(2))


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("x", "x", 1.0), ("x", "y", 0.5), ("y", "x", 0.5), ("y", "y", 1.0)], "a string, b string, s double")
    sinks.matrix(m, str(tmp_path / "m"), ["x", "y"])
    sinks.report(m, str(tmp_path / "r"), order=["a", "b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 4


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet(f"{D}/events.parquet").select("ts", "event_type", "value")
    table.write.parquet(str(tmp_path / "in"))
    q = tumbling_counts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("counts")) == key(tumbling_counts(table))
    assert tumbling_counts(table).agg(F.sum("n")).first()[0] == table.count()
