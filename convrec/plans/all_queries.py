"""Imports every query module so that all queries are registered."""

from convrec.plans import q_dialogue, q_graph, q_interactions, q_mentions, q_stage_a  # noqa: F401
from convrec.plans.registry import REGISTRY  # noqa: F401


def flagship(spark, sf_dir):
    from convrec.plans.q_stage_a import minimum_slice

    return minimum_slice(spark, sf_dir)
