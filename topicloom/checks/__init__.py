"""All registered queries; importing the modules fills the registry."""

from topicloom.checks import cluster_checks, label_checks, model_checks, record_checks, text_checks, topic_checks  # noqa: F401
from topicloom.checks.registry import ORACLES, QUERIES  # noqa: F401
