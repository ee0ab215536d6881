"""Plan-time settings of rule mining, one group for each pass that reads them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from fileledger import fixed_values as V


@dataclass(frozen=True)
class PathSettings:
    """How far a path is generalised."""

    #: Leading folders that stay, and the fewest that do where depth follows the path.
    levels: int = V.PROFILES["balanced"]["levels"]
    least_levels: int = V.LEAST_LEVELS
    #: Most wildcards in a path.
    wildcards: int = V.MOST_WILDCARDS
    any_profile: bool = True
    any_version: bool = True
    #: The depth follows the path, or the vendor folder below Program Files.
    fit_depth: bool = True
    fit_program_files: bool = True
    #: Heads are taken from folders; off, from all segments.
    folders_only: bool = True


@dataclass(frozen=True)
class PairSettings:
    """Which two conditions become a pair, and what is shown with it."""

    by_head: bool = True
    creators: bool = False
    any_process: bool = False
    examples: int = V.EXAMPLE_PATHS
    notes: int = 1


@dataclass(frozen=True)
class MergeSettings:
    """Which pairs become rules."""

    least_rows: int = 1
    needs_path: bool = True
    siblings: bool = True
    #: Siblings with nothing narrower in common go to their folder head.
    siblings_to_heads: bool = False
    #: Conditions that a rule with a high-risk process needs; 0 asks for none.
    risky_process_conditions: int = V.RISKY_PROCESS_CONDITIONS


@dataclass(frozen=True)
class FamilySettings:
    """How rules with similar paths become one: off, conservative, balanced or aggressive."""

    strength: str = "balanced"
    members: int = V.FAMILY_MEMBERS
    wildcards: int = V.MOST_WILDCARDS
    by_extension: bool = True

    @property
    def mode(self) -> str:
        wanted = (self.strength or "").strip().lower()
        return wanted if wanted in V.FAMILY_STRENGTHS else "balanced"

    @property
    def least_members(self) -> int:
        """Smallest group whose paths may be compressed."""
        return {"aggressive": max(2, self.members - 1), "conservative": max(5, self.members)}.get(self.mode, self.members)

    @property
    def least_family(self) -> int:
        return max(V.FAMILY_MEMBERS, self.members)


@dataclass(frozen=True)
class RuleSettings:
    """Literals that shape a rule-mining plan. The defaults are the balanced profile."""

    paths: PathSettings = field(default_factory=PathSettings)
    pairs: PairSettings = field(default_factory=PairSettings)
    rules: MergeSettings = field(default_factory=MergeSettings)
    families: FamilySettings = field(default_factory=FamilySettings)
    # Off: path-only families are not generated, so their specific rules survive.
    global_families: bool = True
    # On: pair weights add up the observation count column instead of rows.
    weighted: bool = False

    def for_consolidation(self) -> RuleSettings:
        """Heads of enough folders, as record consolidation requires."""
        deep = V.CONSOLIDATION_LEVELS
        paths = replace(self.paths, levels=max(deep, self.paths.levels), least_levels=max(deep, self.paths.least_levels))
        return replace(self, paths=paths)


def profile_settings(profile: str | None = "balanced") -> RuleSettings:
    """Settings of the conservative, balanced or aggressive profile; others count as balanced."""
    preset = V.PROFILES.get((profile or "").lower(), V.PROFILES["balanced"])
    narrow, broad = preset["narrow"], preset["broad"]
    return RuleSettings(
        paths=PathSettings(levels=preset["levels"], any_profile=not narrow, any_version=not narrow),
        pairs=PairSettings(by_head=not narrow, creators=broad),
        rules=MergeSettings(siblings=not narrow, siblings_to_heads=broad),
    )
