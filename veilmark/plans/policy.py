"""Policies: which action each kind gets, and what outranks what."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from importlib import resources

from ..kinds import ACTIONS, CONFIDENCE, GROUPS, KINDS, LOW, MEDIUM, PolicyError, action_of, kind_of

PROFILES = ("balanced", "strict", "research")


@dataclass(frozen=True)
class Profile:
    name: str
    actions: dict[str, str]
    member_rules: tuple[tuple[str, str, str], ...] = ()  # (glob, action, reason)
    section_rules: tuple[tuple[str, tuple[str, ...]], ...] = ()
    unknown_members: str = "drop"

    def action(self, kind: str) -> str:
        return self.actions.get(kind, "pseudo")

    @property
    def least_confidence(self) -> int:
        return LOW if self.name == "strict" else MEDIUM


@dataclass(frozen=True)
class Options:
    """What a run is asked to do; see plans.policy.effective for precedence."""

    profile: str = "balanced"
    only: str | None = None
    entity: tuple[str, ...] = ()
    mode: str = "pseudonym"  # or encrypt
    logarchive: str = "drop"  # or jsonl
    ordinal: bool = False
    time_shift: int | None = None
    time_shift_mode: str = "date"
    keep_location: bool = False
    keep_cell_ids: bool = False
    generalize_carrier: bool = False
    drop_carrier: bool = False
    pseudo_third_party_packages: bool = False
    drop_text_from_packages: tuple[str, ...] = ()
    on_collision: str = "extend"  # or widen, with larger reserved ranges where a kind's are used up, or error
    residual_context: str = "none"  # or section
    views: str = "all"  # or literal: percent-decoded and base64 texts are left alone
    writing: str = "surface"  # in the writing of the surface, or plain
    unknown: str = "drop"  # or pass
    sqlite: str = "rewrite"  # or drop
    split_domain_tag: bool = False
    preamble: bool = True
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, allowed in (("mode", ("pseudonym", "encrypt")), ("logarchive", ("drop", "jsonl")), ("on_collision", ("extend", "widen", "error")), ("residual_context", ("none", "section")), ("views", ("all", "literal")), ("writing", ("surface", "plain")), ("unknown", ("drop", "pass")), ("sqlite", ("rewrite", "drop"))):
            if getattr(self, name) not in allowed:
                raise PolicyError(f"{name} is one of {', '.join(allowed)}")


def parse_profile(text: str) -> Profile:
    data = tomllib.loads(text)
    actions = {kind_of(k): action_of(v["action"]) for k, v in data.get("entity", {}).items()}
    members = tuple((r["match"], r["action"], r.get("reason", "policy")) for r in data.get("member_rule", ()))
    sections = tuple((r["match"], tuple(r["detect"])) for r in data.get("section_rule", ()))
    return Profile(data["profile"]["name"], actions, members, sections, data.get("unknown_members", {}).get("action", "drop"))


def load_profile(name: str) -> Profile:
    """A bundled profile by name, or a TOML file."""
    if name in PROFILES:
        return parse_profile((resources.files("veilmark") / "policies" / f"{name}.toml").read_text())
    if not name.endswith(".toml"):
        raise PolicyError(f"unknown profile: {name}")
    with open(name, encoding="utf-8") as f:
        return parse_profile(f.read())


def allowlist(name: str) -> tuple[str, ...]:
    """Lines of a bundled list, without comments."""
    lines = (resources.files("veilmark") / "allowlists" / f"{name}.txt").read_text().splitlines()
    return tuple(x.strip() for x in lines if x.strip() and not x.lstrip().startswith("#"))


def parse_kinds(text: str) -> set[str]:
    """Kinds, aliases and groups, between commas or spaces."""
    out: set[str] = set()
    for name in filter(None, re.split(r"[,\s]+", text)):
        group = GROUPS.get(name.lower().replace("-", "_"))
        out |= set(group) if group else {kind_of(name)}
    if not out:
        raise PolicyError("no kind is named")
    return out


def parse_entity(spec: str) -> tuple[set[str], str]:
    """KIND=ACTION; KIND may be a group."""
    kind, eq, action = spec.partition("=")
    if not eq:
        raise PolicyError(f"not KIND=ACTION: {spec}")
    return parse_kinds(kind), action_of(action)


def effective(options: Options) -> Profile:
    """Profile, then convenience flags, then only, then entity overrides; the later wins."""
    base = load_profile(options.profile)
    actions = {k: base.action(k) for k in KINDS}
    if options.keep_location:
        actions["gps_coordinate"] = "keep"
    if options.keep_cell_ids:
        actions["cell_id"] = "keep"
    if options.generalize_carrier:
        actions["carrier"] = "generalize"
    if options.drop_carrier:
        actions["carrier"] = "drop"
    if options.pseudo_third_party_packages:
        actions["package_name"] = "pseudo"
    if options.time_shift is not None:
        actions["timestamp"] = "shift"
    if options.only:
        chosen = parse_kinds(options.only)
        actions = {k: (a if a != "keep" else "pseudo") if k in chosen else "keep" for k, a in actions.items()}
    for spec in options.entity:
        kinds, action = parse_entity(spec)
        actions |= dict.fromkeys(kinds, action)
    return Profile(base.name, actions, base.member_rules, base.section_rules, base.unknown_members)


def describe(options: Options) -> str:
    """A line for each kind: name, action, and why where it is not the profile's."""
    profile, chosen = effective(options), parse_kinds(options.only) if options.only else None
    forced = set().union(*(parse_entity(s)[0] for s in options.entity)) if options.entity else set()
    lines = [f"profile: {profile.name}"]
    if chosen is not None:
        lines.append(f"only: {', '.join(sorted(chosen))}")
    for k in KINDS:
        note = " (override)" if k in forced else " (outside --only)" if chosen is not None and k not in chosen else ""
        lines.append(f"{k:<20} {profile.action(k)}{note}")
    return "\n".join(lines)


def catalog() -> dict[str, list[str]]:
    return {"kinds": list(KINDS), "groups": sorted(GROUPS), "actions": list(ACTIONS), "confidences": list(CONFIDENCE), "profiles": list(PROFILES)}
