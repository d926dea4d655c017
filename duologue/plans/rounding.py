"""Columns of floating-point results, by query: both engines round them to six places before comparing."""

ROUNDED = {
    "a04_episode_records": ["goal"],
    "a06_trajectory_pool": ["goals"],
    "b07_flat_scores": ["goal", "relationship", "knowledge", "overall"],
    "b14_progress_score": ["progress"],
    "b15_first_last_delta": ["goal_delta", "knowledge_delta"],
    "b16_canvas_scale": ["x", "y"],
    "c11_completeness": ["fill_rate"],
    "d05_calibration_join": ["prior_alpha", "prior_beta"],
    "d06_paired_deltas": ["goal_delta", "knowledge_delta", "success_delta"],
    "d07_contrast_pairs": ["fail_goal", "success_goal"],
    "d08_improvement_pairs": ["base_goal", "best_goal"],
    "d10_inferred_parents": ["sim"],
    "d10_top_k_neighbours": ["sim"],
    "d11_retrieve_one_perspective": ["sim"],
    "d12_other_lineage_neighbours": ["sim"],
    "d14_contamination": ["threshold"],
    "d14_semantic_overlaps": ["sim"],
    "d15_near_duplicates": ["sim"],
    "d16_within_batch": ["within_batch_dupe"],
    "d17_nearest_seed_distance": ["distance"],
    "d17_self_distance": ["distance"],
    "d18_closest_parent": ["d2"],
    "e02_dimension_means": ["mean", "std"],
    "e02_sweep_totals": ["pass_rate"],
    "e03_pass_rate_by_source": ["pass_rate"],
    "e05_dimension_stats_by_source": ["mean", "std"],
    "e05_hard_vs_rest": ["mean_goal", "std_goal", "success_rate"],
    "e06_lp_stats": ["mean", "std"],
    "e07_direction_check": ["escalate_rate", "lateral_rate"],
    "e07_operator_class_crosstab": ["fraction"],
    "e09_condition_summary": ["goal_mean", "relationship_mean", "knowledge_mean", "success_rate_goal_rel", "terminal_success_rate"],
    "e10_vote_collapse": ["lp_value"],
    "e14_gini": ["gini"],
    "e15_lineage_statistics": ["branching_factor", "median_chain_depth", "fanout_gini", "mean_dist_to_nearest_seed", "mean_dist_to_parent"],
    "e16_cell_coverage": ["coverage"],
    "e17_coverage_by_method": ["coverage"],
    "e18_mean_pairwise_distance": ["mean_distance"],
    "e19_two_set_composition": ["chi2", "p_value"],
    "e21_wilson_by_source": ["n", "share", "lo", "hi"],
    "e22_trend_statistic": ["r"],
    "e24_judge_error": ["mae", "pearson"],
    "e24_judge_quality": ["accuracy", "precision", "recall"],
    "e25_fidelity_by_source": ["leaked_rate", "early_yield_rate", "ignored_trigger_rate"],
    "e27_go_no_go": ["headroom", "gap"],
    "e29_call_usage": ["mean_ms", "max_ms"],
    "e30_solve_report": ["solve_rate", "mean_goal", "mean_attempts"],
    "e31_amplification": ["amplification", "chi2_term"],
    "e32_generation_summary": ["ok_rate", "pass_rate", "mean_seconds"],
    "f01_sliding_frontier_share": ["mean", "lo", "hi"],
    "f02_learning_slope": ["slope"],
    "f05_half_means": ["first_half", "second_half"],
    "f06_child_priors": ["prior_alpha", "prior_beta"],
    "f08_coverage_growth": ["coverage"],
    "g02_mode_representatives": ["goal"],
    "g04_newest": ["value"],
    "g08_top_overlaps": ["sim"],
    "h02_union_of_methods": ["x"],
    "i01_cosine_conventions": ["plain", "eps"],
    "l01_degree_stats": ["branching_factor"],
    "m06_trajectories": ["goal_score"],
    "s01_latest_versions": ["value"],
    "s03_bounded_slope": ["slope"],
    "s04_admission": ["within_batch_dupe"],
}
