"""The relational model of traces.

Three tables: ``trajectories`` (one row a trace), ``steps`` (one row a step, with its calls and its
result nested) and ``events`` (one row a finding). All are keyed by ``traj_key``, a surrogate of
(file, position): trajectory ids are not unique.
"""

from __future__ import annotations

ROLES = ("system", "user", "assistant", "tool", "agent")

CALL = "struct<id: string, name: string, arguments: string, args_key: string, raw_arguments: string, parse_error: string>"
RESULT = "struct<call_id: string, name: string, content: string, is_error: boolean>"
STEPS = f"traj_key string, trajectory_id string, step_index int, role string, agent string, content string, calls array<{CALL}>, result {RESULT}"
TRAJECTORIES = (
    "traj_key string, trajectory_id string, domain string, instruction string, user_id string, policy string, "
    "tool_schemas array<string>, expected_actions array<string>, reward double, metadata string, n_steps int"
)
EVENTS = "traj_key, step_index int, kind string, severity double, evidence string, signal_ord int, emit_ord int"
