"""Every registered query is well formed; a cross-section is compared with its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "ca1_major_minor_allele ca10_site_quality ca13_burden_tables ca14_filter_combinations cv3_double_zscore cv5_histogram_exact "
    "mg1_runs_above mg4_merge_regions mg5_split_at_contigs an2_site_to_genes an3_site_to_one_gene an4_annotate_snv an6_dedup_annotation "
    "rc1_local_correlation rc5_depth_segments tr1_pairwise_snp tr2_nearest_other_class tr5_mrca tr7_homoplasy_distance "
    "tr9_spectrum_per_subtree as3_rank_hits as5_n50_l50 ev3_expected_pn tr3_lineage_clusters an1_pos_to_contig an5_promoter_or_intergenic rc5_depth_shares gr4_sliding_rate sv4_survival_share af5_interp_grid "
    "sv2_kaplan_meier st1_mann_whitney pu1_pileup_counts src13_read_cluster_file"
).split()


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 180
    assert set(sql) <= set(queries)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, FOLDER).columns
        return
    assert compare(entry.queries()[name](spark, FOLDER), con, sql) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {"sample", "lineage", "size"} == set(rows[0].asDict())
    assert len(rows) == 10 and all(r["size"] == sum(x.lineage == r.lineage for x in rows) for r in rows)
