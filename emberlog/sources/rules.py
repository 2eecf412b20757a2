"""Classification rules: an ordered list, first match wins. Small by nature, so it lives on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable
from importlib import resources
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = (
    "priority int, name string, pattern string, classification string, title string, "
    "possible_causes array<string>, recommended_actions array<string>"
)


class Rule(NamedTuple):
    priority: int
    name: str | None
    pattern: str
    classification: str
    title: str
    possible_causes: list[str]
    recommended_actions: list[str]


def make_rules(items: Iterable[dict[str, Any]]) -> list[Rule]:
    """Rules of plain dictionaries in order, with the defaults for what is missing. A rule without a pattern never fires."""
    rules = []
    for priority, item in enumerate(items):
        name = item.get("name")
        classification = str(item.get("classification", "UNKNOWN"))
        title = str(item.get("insight") or name or f"{classification} detected")
        causes = [str(x) for x in item.get("possible_causes", [])]
        actions = [str(x) for x in item.get("actions", [])]
        pattern = str(item.get("pattern", ""))
        rules.append(Rule(priority, name and str(name), pattern, classification, title, causes, actions))
    return rules


def load_rules(path: str | Path | None = None) -> list[Rule]:
    """Rules of a JSON or YAML file with a ``rules`` list; the packaged ones without a path."""
    if path is None:
        text = resources.files("emberlog.rules").joinpath("default_rules.json").read_text(encoding="utf-8")
        payload = json.loads(text)
    else:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("YAML rules need PyYAML; give the rules as JSON instead") from error
            payload = yaml.safe_load(text)
        else:
            payload = json.loads(text)
    items = (payload or {}).get("rules", [])
    if not isinstance(items, list):
        raise ValueError("the rule file must hold a list under the 'rules' key")
    return make_rules(items)


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)
