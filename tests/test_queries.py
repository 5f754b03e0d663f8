"""Registered queries against their SQL, at the smallest scale."""

import os

import duckdb
import pytest

from genoquill.plans import registry

registry.load()
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{D}/{f}')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([tuple(clean(r[i]) for i in order) for r in rows], key=str)


#: Those that take long in the small are compared by hand at sf0.01 with the others.
QUICK = ["snp_pass_by_contig", "canonical_form", "modify_filter", "homozygous_offsets", "coding_highest_af", "template_semi_join", "allele_summary_by_variant", "af_bins_fws", "zygosity_by_genome", "gini_hrel_iqv", "tile_stats", "tile_gaps", "percentile_index", "interval_union", "citation_percent", "ancestor_closure", "similarity_lin", "inbreeding_ritland", "translation", "interval_join_genes", "gene_carriers", "spaced_loci", "upstream_delete_filter", "graph_components", "frontier_information", "vcf_round_trip", "gff_round_trip", "obo_edges", "offset_translation", "clinvar_genes", "tile_info", "kmers_and_motifs"]


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, D)
    rows = got.collect()
    cur = oracle.execute(registry.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert normal([tuple(r) for r in rows], got.columns) == normal(cur.fetchall(), names)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES) and len(registry.QUERIES) > 100
