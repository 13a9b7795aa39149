"""Rule catalogue: records, packs and selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from scanfold.catalog import government, healthcare, security, standards, telecom
from scanfold.catalog.model import ANY, Pattern, Rule, pats

BUILTIN_RULES: tuple[Rule, ...] = (
    security.RULES + standards.RULES + healthcare.RULES + telecom.RULES + government.RULES
)

# --- Fixed values: packs (name, display name, description, category) --------
PACK_INFO = (
    ("default-security", "Default Security", "Basic security rules for common vulnerabilities", "default"),
    ("enterprise-standards", "Enterprise Standards", "Common enterprise coding standards", "default"),
    ("healthcare", "Healthcare (HIPAA)", "HIPAA compliance rules for healthcare applications", "healthcare"),
    ("telecom", "Telecom", "Telecom industry compliance rules", "telecom"),
    ("government", "Government (FedRAMP)", "FedRAMP compliance rules for government applications", "government"),
)
DEFAULT_SCAN_PACKS = ("default-security",)
SEVERITIES = ("critical", "high", "medium", "low", "info")


@dataclass
class Catalogue:
    """An ordered set of rules and packs; order decides which duplicate wins."""

    rules: dict[str, Rule] = field(default_factory=dict)
    packs: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def builtin(cls) -> "Catalogue":
        catalogue = cls({r.rule_id: r for r in BUILTIN_RULES})
        for name, *_ in PACK_INFO:
            catalogue.packs[name] = tuple(r.rule_id for r in BUILTIN_RULES if r.pack == name)
        return catalogue

    def register_rule(self, rule: Rule) -> "Catalogue":
        return Catalogue({**self.rules, rule.rule_id: rule}, dict(self.packs))

    def unregister_rule(self, rule_id: str) -> "Catalogue":
        return Catalogue({k: v for k, v in self.rules.items() if k != rule_id}, dict(self.packs))

    def register_pack(self, name: str, rule_ids) -> "Catalogue":
        return Catalogue(dict(self.rules), {**self.packs, name: tuple(rule_ids)})

    def get_rule(self, rule_id: str) -> Rule | None:
        return self.rules.get(rule_id)

    def list_rules(self) -> list[Rule]:
        return list(self.rules.values())

    def list_packs(self) -> dict[str, tuple[str, ...]]:
        return dict(self.packs)

    def pack_rules(self, name: str) -> list[Rule]:
        return [self.rules[i] for i in self.packs.get(name, ()) if i in self.rules]

    def select(self, rule_ids=None, packs=None, category: str | None = None) -> list[Rule]:
        """Explicit ids win over packs, packs over everything; unknown names are ignored."""
        if rule_ids:
            chosen = [self.rules[i] for i in rule_ids if i in self.rules]
        elif packs:
            chosen = [r for p in packs for r in self.pack_rules(p)]
        else:
            chosen = self.list_rules()
        if category:
            chosen = [r for r in chosen if r.category == category]
        return [self.rules[i] for i in dict.fromkeys(r.rule_id for r in chosen)]

    def languages(self) -> list[str]:
        names: dict[str, None] = {}
        for rule in self.rules.values():
            for language in tuple(rule.languages) + tuple(rule.patterns):
                if language != ANY:
                    names.setdefault(language.lower())
        return list(names)


__all__ = ["ANY", "BUILTIN_RULES", "Catalogue", "DEFAULT_SCAN_PACKS", "PACK_INFO", "Pattern", "Rule",
           "SEVERITIES", "pats"]
