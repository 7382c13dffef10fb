"""DataFrame-to-DataFrame operators on the canonical log."""

from tideline.operators.failures import fail_first_attempts
from tideline.operators.incidents import (detect_incidents, incident_sessions,
                                          recovery_percentiles, time_to_recovery, worst_incidents)
from tideline.operators.normalise import (canonical_events, dedupe_events, duplicate_report,
                                          enrich_entity, out_of_order_audit, replay_slice,
                                          sequence_gaps, total_order)
from tideline.operators.ordered import Layout, measure
from tideline.operators.recovery import (cuts, extend_cuts, read_cut, recover_state, recovery_point,
                                         repair_log, snapshot_at, snapshots, state_at, tail_events,
                                         withdraw_cuts)
from tideline.operators.replay import (error_streaks, fold_events, fold_events_py, hash_chain,
                                       replay_as_of, replay_final_state, replay_running_state)
from tideline.operators.sweep import (concurrent_incidents, merge_overlapping,
                                      overlapping_incidents)
from tideline.operators.timeline import (daily_rollup, error_burst, error_rate_sliding,
                                         error_rate_tumbling, event_transitions, incident_path,
                                         incident_summary, incident_timeline, precursor_event,
                                         state_spans, timeline_grid)
from tideline.operators.tree import compare_trees, store_tree, tree_diff
from tideline.operators.validate import (bucket_digest_diff, bucket_digests, compare_states,
                                         determinism_check, first_divergence, idempotence_check,
                                         invariant_report, log_diff, multiset_digest,
                                         ordered_digest, reconcile_events, row_digest,
                                         snapshot_check, validation_summary)

__all__ = [name for name in dir() if not name.startswith("_")]
