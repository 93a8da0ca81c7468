"""Registered queries: importing this package fills the registry."""

from vitalframe.plans import budgets, checks, clinical, formats, images, modelling, protection, resources, rules, statistics, timelines  # noqa: F401
