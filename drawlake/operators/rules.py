"""The rules file and its compiler: each rule becomes column expressions, so applying all rules is one pass without a join.

A rule is a mapping: category, when and unless (field -> pattern), emit (one of EMITS), and what the mode needs. Patterns search,
ignore case, and stay literals of the plan, so each is compiled once per task.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawlake.functions import text as X

EMITS = ("text", "const", "split", "capture", "connector_label", "connector_id", "template")
# Fixed value: the order of a rule's fields in the rules file.
KEY_ORDER = ["category", "source", "note", "when", "unless", "emit", "pattern_field", "pattern", "template", "value", "keep_legend_codes", "min_conf"]


@dataclass
class RuleSet:
    """rules, and the settings that hold for all of them."""

    rules: list[dict[str, Any]]
    normalise: dict[str, bool] = field(default_factory=dict)
    suppress_region_kinds: list[str] = field(default_factory=list)
    min_confidence: float = 0.0

    @classmethod
    def of(cls, document: dict) -> RuleSet:
        return cls(document.get("rules") or [], document.get("normalise") or {}, document.get("suppress_region_kinds") or [], document.get("min_confidence", 0.0))

    def document(self) -> dict:
        return {
            "rules": [ordered(r) for r in self.rules],
            "normalise": self.normalise,
            "suppress_region_kinds": self.suppress_region_kinds,
            "min_confidence": self.min_confidence,
        }

    def norm(self, text: Column) -> Column:
        known = ("strip", "collapse_whitespace", "join_tag_prefix", "uppercase")
        return X.normalise(text, **{k: v for k, v in self.normalise.items() if k in known})


def ordered(rule: dict) -> dict:
    """Known keys in their order, then the others."""
    return {k: rule[k] for k in KEY_ORDER if k in rule} | {k: v for k, v in rule.items() if k not in KEY_ORDER}


def all_match(conditions: dict[str, str] | None) -> Column:
    """Every field holds its pattern; true without conditions."""
    out = F.lit(True)
    for name, pattern in (conditions or {}).items():
        out = out & X.searches(F.col(name), pattern)
    return out


def any_match(conditions: dict[str, str] | None) -> Column:
    out = F.lit(False)
    for name, pattern in (conditions or {}).items():
        out = out | X.searches(F.col(name), pattern)
    return out


def fallback(rule: dict) -> Column:
    """The wording test of a rule that is checked visually, for readings without a verdict."""
    check = rule.get("verify") or {}
    return all_match(check.get("fallback_when")) & ~any_match(check.get("fallback_unless"))


def matches(rule: dict, verdicts: Column | None = None) -> Column:
    """Whether the rule takes a reading. verdicts: map category -> boolean of the reading's tag, or null."""
    out = (F.coalesce(F.col("confidence"), F.lit(1.0)) >= F.lit(float(rule.get("min_conf", 0)))) & all_match(rule.get("when"))
    if rule.get("unless"):
        out = out & ~any_match(rule["unless"])
    if rule.get("verify"):
        seen = F.lit(None).cast("boolean") if verdicts is None else F.try_element_at(verdicts, F.lit(rule["category"]))
        out = out & F.coalesce(seen, fallback(rule))
    return out


def _first_group(name: str, pattern: str) -> tuple[Column, Column]:
    source = F.coalesce(F.col(name), F.lit(""))
    return X.searches(source, pattern), F.regexp_extract(source, X.FLAGS + pattern, 1)


def emitted(rule: dict, codes: Column | None = None) -> Column:
    """Values (array<string>) that the rule writes for a reading it takes, before they are normalised."""
    mode, text = rule.get("emit", "text"), F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    if mode == "text":
        return F.array(text)
    if mode == "const":
        return F.array(F.lit(rule["value"]))
    if mode == "split":
        parts = X.split_codes(text)
        if not rule.get("keep_legend_codes") or codes is None:
            return parts
        return F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, parts).otherwise(F.filter(parts, lambda p: F.array_contains(codes, F.upper(F.trim(p)))))
    if mode == "capture":
        found, group = _first_group("text", rule["pattern"])
        return F.when(found, F.array(group)).otherwise(none)
    if mode in ("connector_id", "connector_label"):
        ident = X.connector_id(F.col(rule.get("id_field", "text") if mode == "connector_label" else "text"))
        value = ident if mode == "connector_id" else F.trim(F.concat_ws(" ", ident, X.connector_description(text, rule.get("strip"))))
        return F.when(ident.isNotNull(), F.array(value)).otherwise(none)
    if mode == "template":
        found, group = _first_group(rule.get("pattern_field", "text"), rule["pattern"])
        holes = {"{name}": F.upper(group), "{text}": text}
        parts = [holes.get(p, F.lit(p)) for p in re.split(r"(\{name\}|\{text\})", rule["template"]) if p]
        return F.when(found, F.array(F.concat(*parts))).otherwise(none)
    raise ValueError(f"unknown emit mode {mode!r}; known: {', '.join(EMITS)}")


def applied(ruleset: RuleSet, codes: Column | None = None, verdicts: Column | None = None) -> Column:
    """array<struct<rule, category, values>>: an entry per rule that takes the reading, values normalised and not empty."""
    entries = []
    for i, rule in enumerate(ruleset.rules):
        values = F.filter(F.transform(emitted(rule, codes), lambda v: ruleset.norm(v)), lambda v: v != "")
        entries.append(F.when(matches(rule, verdicts), F.struct(F.lit(i).alias("rule"), F.lit(rule["category"]).alias("category"), values.alias("values"))))
    if not entries:
        return F.array().cast("array<struct<rule:int,category:string,values:array<string>>>")
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def pattern_error(pattern: str) -> str | None:
    """What the JVM, which will run it, has against a pattern; None if it compiles."""
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(X.FLAGS + pattern)
    except IllegalArgumentException as e:
        return str(e).splitlines()[0]
    return None


def validate(action: str, index: int | None, rule: dict, ruleset: RuleSet) -> str | None:
    """Why a proposed rule can't be taken, or None."""
    conditions = rule.get("when") or {}
    places = {f"{part}/{name}": p for part in ("when", "unless") for name, p in (rule.get(part) or {}).items()} | ({"pattern": rule["pattern"]} if rule.get("pattern") else {})
    findings = [f"{place} does not compile: {why}" for place, p in places.items() if (why := pattern_error(p))]
    if not conditions:
        findings.append("without a condition it would take every reading")
    if action == "modify" and index not in range(len(ruleset.rules)):
        findings.insert(0, f"there is no rule {index} to modify")
    return "; ".join(findings) or None


# field of a proposal -> (emit modes that use it, what stands where it is left out); None: every mode.
PROPOSED = {
    "pattern": (("capture", "template"), None),
    "pattern_field": (("template",), "text"),
    "template": (("template",), "{name} {text}"),
    "keep_legend_codes": (("split",), None),
}


def from_proposal(proposal: dict) -> dict:
    """A rule out of a proposal, whose conditions are lists of field and pattern."""
    maps = {part: {c["field"]: c["pattern"] for c in proposal.get(part) or ()} for part in ("when", "unless")}
    told = {name: proposal.get(name) or default for name, (modes, default) in PROPOSED.items() if proposal["emit"] in modes}
    whole = {
        "category": proposal["category"], "emit": proposal["emit"], "note": proposal["reason"], "source": f"rule assistant ({proposal['source']})",
        "when": maps["when"], **({"unless": maps["unless"]} if maps["unless"] else {}), **{k: v for k, v in told.items() if v},
    }
    return ordered(whole)


#: What an assistant can state about a rule; a modified rule keeps all else.
STATED = {"category", "source", "note", "when", "unless", "emit", "pattern", "pattern_field", "template", "keep_legend_codes"}


def with_proposal(ruleset: RuleSet, action: str, index: int | None, rule: dict) -> RuleSet:
    """A copy of the rules with one added or replaced. Fields that a proposal can't state are carried over."""
    out = copy.deepcopy(ruleset)
    if action == "add":
        out.rules.append(rule)
    else:
        out.rules[index] = {k: v for k, v in out.rules[index].items() if k not in STATED} | rule
    return out


def changed_since(ruleset: RuleSet, index: int, before: dict) -> bool:
    """Whether the rule is no longer what the proposal saw."""
    return not 0 <= index < len(ruleset.rules) or ruleset.rules[index] != before


PROPOSAL_STATES = {"pending": ("accepted", "rejected")}


def decided(proposal: dict, action: str) -> dict:
    """The proposal accepted or rejected; only a pending and valid one can be accepted."""
    if action not in PROPOSAL_STATES.get(proposal["status"], ()):
        raise ValueError(f"a proposal that is {proposal['status']} can't become {action}")
    if action == "accepted" and proposal.get("invalid"):
        raise ValueError(proposal["invalid"])
    return proposal | {"status": action}
