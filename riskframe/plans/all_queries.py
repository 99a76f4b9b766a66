"""Import every query module so their ``@register`` calls run."""

import importlib

MODULES = ["q_timeline", "q_survey", "q_scoring", "q_labels", "q_models", "q_serving", "q_sources"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"riskframe.plans.{m}")
