"""Registered queries beside their SQL twins on the small tables.

One or more per family by default; FATHOMGRAPH_ALL=1 runs every registered query.
"""

import os

import pytest
from compare import connect, differences

from fathomgraph.plans import catalog

SF = "/root/testdata/sf0.001"
QUICK = [
    "a1_preprints_of_category", "a4_cited_papers_of_dates", "a6_ingest_report", "a7_dictionary_file", "a11_json_array_scan", "a12_sinks",
    "b2_abstract_from_index", "b3_clean_full", "c3_concept_ids", "c5_document_frequency", "c6_cooccurrence", "c7_cooccurrence_occurrences",
    "d5_refined_dictionary", "e1_pivot_mentions", "f6_node_table", "f7_pair_table", "g1_adjacency", "g5_pagerank", "g6_shared_neighbours",
    "g11_unconnected_pairs", "g10_pair_counts", "h2_all_solutions", "h4_conditional_split", "i3_node_citation_features", "i5_pair_citations",
    "i10_feature_matrix", "j2_split_per_class", "j3_shuffled_solutions", "j6_auc", "j8_best_threshold", "k2_top_pairs", "k5_score_summary", "k6_rank_and_quantile",
    "k10_category_matrix", "l1_first_per_name", "l5_drop_plurals", "l7_frequency_table", "m3_candidate_spans", "m5_expanded_relations",
    "a10_quoted_csv_by_splits", "a11_json_lists_by_splits", "c3_rare_anchor_ids", "e2_mixed_records", "h8_stored_lookup", "k2_top_part_pairs",
    "j1_bottom_k_subsets", "j2_split_by_cells", "j9_impact_optimality", "m7_pruned_spans", "m8_suppressed_in_rounds", "m8_suppressed_same_label", "m9_decoded_relations", "m11_relation_scores", "n1_incremental_mentions",
]
NAMES = sorted(catalog.QUERIES) if os.environ.get("FATHOMGRAPH_ALL") else QUICK
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, con):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert differences(name, df, con, catalog.ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


PLANNED = ["c6_cooccurrence", "f6_node_table", "g1_adjacency", "g11_unconnected_pairs", "c3_concept_ids", "l5_drop_plurals", "m7_pruned_spans", "k6_rank_and_quantile"]


@needs_data
@pytest.mark.parametrize("name", PLANNED)
def test_plan_has_no_cross_join_or_global_window(name, spark):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Exchange SinglePartition" not in plan


@needs_data
def test_scan_reads_only_needed_columns_and_prunes_folders(spark, tmp_path):
    from fathomgraph.plans import inputs
    from fathomgraph.sources import readers

    plan = inputs.bare_mentions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_name" not in plan
    spark.sql("select '{}' as value, date '1997-01-01' as updated_date").write.partitionBy("updated_date").text(f"{tmp_path}/x")
    plan = readers.read_cited_papers(spark, f"{tmp_path}/x", "1996-01-01", "1998-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(updated_date" in plan
