"""Registered queries (each module registers on import)."""

_MODULES = (
    "searchlane.plans.retrieval_plans",
    "searchlane.plans.text_plans",
    "searchlane.plans.rl_plans",
    "searchlane.plans.agent_plans",
    "searchlane.plans.dataset_plans",
    "searchlane.plans.streaming_plans",
    "searchlane.plans.io_plans",
    "searchlane.plans.extra_plans",
)


def load_all() -> None:
    import importlib
    for m in _MODULES:
        importlib.import_module(m)
