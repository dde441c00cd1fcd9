"""Rule catalogs: TOML files to checked rules, and rules to the tables that the matcher joins.

A rule has steps (an implicit variant `default`) and variants with a core, contexts and boundaries. Steps are token
predicates, optional or not, or bounded gaps (wildcards). Compilation rewrites every sequence of steps:

* each choice of optional steps becomes a form of its own, which remembers its place in the order of search;
* forms are cut at their gaps into segments of adjacent predicates, and equal segments are shared;
* predicates become disjunctions of plain conjunctions, each filed under its most selective field.
"""

from __future__ import annotations

import itertools
import tomllib
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FIELDS = ("surface", "pos1", "pos2", "conj_form", "base_form")
#: Fields by how few tokens they leave, best first.
SELECTIVE = ("surface", "base_form", "conj_form", "pos2", "pos1")
BOUNDARIES = ("clause", "sentence")
#: Steps between two gaps: the matcher marks them in the bits of a long.
MOST_STEPS = 62
ALIASES = {"core": ("steps", "core_steps"), "left_context": ("left",), "right_context": ("right",), "left_boundary": ("start_boundary",), "right_boundary": ("end_boundary",)}


class CatalogError(ValueError):
    """A catalog that breaks a rule of the format."""


@dataclass
class Step:
    fields: dict[str, str] = field(default_factory=dict)
    one_of: list[dict[str, str]] = field(default_factory=list)
    gap: tuple[int, int] | None = None
    optional: bool = False
    capture: str | None = None

    @property
    def specificity(self) -> int:
        """Direct fields plus those of the largest alternative, whichever one matches."""
        return len(self.fields) + max(map(len, self.one_of), default=0)

    def conjunctions(self) -> list[dict[str, str]]:
        """The plain conjunctions whose disjunction the step is; contradictions are left out."""
        out = []
        for other in self.one_of or [{}]:
            if all(self.fields.get(k, v) == v for k, v in other.items()):
                both = {**self.fields, **other}
                if both not in out:
                    out.append(both)
        return out


@dataclass
class Variant:
    id: str
    core: list[Step]
    left: list[Step] = field(default_factory=list)
    right: list[Step] = field(default_factory=list)
    left_boundary: str | None = None
    right_boundary: str | None = None
    absorb: bool = False
    priority: int | None = None
    sense_id: str | None = None
    ambiguity_group: str | None = None
    fallback: bool | None = None


@dataclass
class Rule:
    id: str
    name: str = ""
    jlpt: str = ""
    meaning_en: str = ""
    hint: str | None = None
    steps: list[Step] = field(default_factory=list)
    variants: list[Variant] = field(default_factory=list)
    priority: int = 0
    sense_id: str | None = None
    ambiguity_group: str | None = None
    fallback: bool = False
    source: tuple[str, str] = ("", "")

    def effective(self) -> list[Variant]:
        """All variants, `default` first, with what they inherit from the rule."""
        own = [Variant("default", self.steps)] if self.steps else []
        out = []
        for v in own + self.variants:
            either = lambda a, b: b if a is None else a
            out.append(
                Variant(v.id, v.core, v.left, v.right, v.left_boundary, v.right_boundary, v.absorb, either(v.priority, self.priority), either(v.sense_id, self.sense_id), either(v.ambiguity_group, self.ambiguity_group), either(v.fallback, self.fallback))
            )
        return out


def _step(raw: dict, where: str) -> Step:
    known = {*FIELDS, "wildcard", "optional", "one_of", "capture"}
    if extra := set(raw) - known:
        raise CatalogError(f"{where}: unknown step fields {sorted(extra)}")
    gap = raw.get("wildcard")
    one_of = [{"surface": a} if isinstance(a, str) else {k: a[k] for k in FIELDS if a.get(k) is not None} for a in raw.get("one_of", [])]
    return Step({k: raw[k] for k in FIELDS if raw.get(k) is not None}, one_of, (gap["min"], gap["max"]) if gap is not None else None, bool(raw.get("optional", False)), raw.get("capture"))


def _given(raw: dict, name: str, default=None):
    for key in (name, *ALIASES.get(name, ())):
        if key in raw:
            return raw[key]
    return default


def parse_toml(text: str, where: str, source: tuple[str, str] = ("", "")) -> list[Rule]:
    """Checked rules of one file, stamped with their source."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise CatalogError(f"invalid TOML in {where}: {e}") from e
    rules = []
    for r in raw.get("patterns", []):
        variants = []
        for v in r.get("variants", []):
            steps = {k: [_step(s, where) for s in _given(v, k, [])] for k in ("core", "left_context", "right_context")}
            variants.append(
                Variant(v.get("id", ""), steps["core"], steps["left_context"], steps["right_context"], _given(v, "left_boundary"), _given(v, "right_boundary"), bool(v.get("absorb_left_context", False)), v.get("priority"), v.get("sense_id"), v.get("ambiguity_group"), v.get("fallback"))
            )
        rules.append(
            Rule(r.get("id", ""), r.get("name", ""), r.get("jlpt", ""), r.get("meaning_en", ""), r.get("hint"), [_step(s, where) for s in r.get("steps", [])], variants, r.get("priority", 0), r.get("sense_id"), r.get("ambiguity_group"), bool(r.get("fallback", False)), source)
        )
    if found := list(violations(rules)):
        raise CatalogError(f"{where}: {found[0]}")
    return rules


def _quoted(value: str) -> str:
    """A basic TOML string."""
    plain = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}
    return '"' + "".join(plain.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 else c) for c in value) + '"'


def _inline(fields: dict) -> str:
    return "{ " + ", ".join(f"{k} = {v}" for k, v in fields.items()) + " }"


def _inline_step(s: Step) -> str:
    out = {k: _quoted(s.fields[k]) for k in FIELDS if k in s.fields}
    if s.gap is not None:
        out["wildcard"] = _inline({"min": s.gap[0], "max": s.gap[1]})
    if s.one_of:
        out["one_of"] = "[" + ", ".join(_inline({k: _quoted(o[k]) for k in FIELDS if k in o}) for o in s.one_of) + "]"
    if s.optional:
        out["optional"] = "true"
    if s.capture is not None:
        out["capture"] = _quoted(s.capture)
    return _inline(out)


def render_toml(rules: list[Rule]) -> str:
    """The file that parse_toml() reads as these rules; fields at their defaults are left out."""

    def lines(x, names) -> list[str]:
        shown = {str: _quoted, bool: lambda b: str(b).lower(), int: str}
        return [f"{key} = {shown[type(value)](value)}" for key, value in ((key, getattr(x, name)) for name, key in names) if value is not None and value != "" and (value or isinstance(x, Variant))]

    def steps(name: str, some: list[Step]) -> list[str]:
        return [f"{name} = [", *[f"  {_inline_step(s)}," for s in some], "]"] if some else []

    both = [("priority", "priority"), ("sense_id", "sense_id"), ("ambiguity_group", "ambiguity_group"), ("fallback", "fallback")]
    out = []
    for r in rules:
        out += ["[[patterns]]", *lines(r, [(k, k) for k in ("id", "name", "jlpt", "meaning_en", "hint")] + both), *steps("steps", r.steps), ""]
        for v in r.variants:
            own = [("id", "id"), ("left_boundary", "left_boundary"), ("right_boundary", "right_boundary"), ("absorb", "absorb_left_context")] + both
            out += ["[[patterns.variants]]", *lines(v, own), *steps("left_context", v.left), *steps("core", v.core), *steps("right_context", v.right), ""]
    return "\n".join(out)


def violations(rules: list[Rule]):
    """What is wrong with rules, in words."""
    for rule in rules:
        if not rule.id:
            yield "a rule has no id"
        if not rule.steps and not rule.variants:
            yield f"rule {rule.id} matches nothing: neither steps nor variants"
        yield from _step_violations(rule.steps, rule.id)
        seen = set()
        for v in rule.variants:
            if not v.id:
                yield f"rule {rule.id} has a variant without id"
            if v.id in seen:
                yield f"rule {rule.id} has two variants {v.id}"
            seen.add(v.id)
            if not v.core:
                yield f"rule {rule.id} variant {v.id} has no core"
            for boundary in (v.left_boundary, v.right_boundary):
                if boundary is not None and boundary not in BOUNDARIES:
                    yield f"rule {rule.id} variant {v.id} has an unknown boundary {boundary}"
            for steps in (v.core, v.left, v.right):
                yield from _step_violations(steps, rule.id)


def _step_violations(steps: list[Step], rule: str):
    for s in steps:
        if s.gap is not None:
            if s.gap[0] > s.gap[1]:
                yield f"rule {rule} has a gap whose min is above its max"
            if s.fields or s.one_of:
                yield f"rule {rule} mixes a gap and token fields"
        elif not s.fields and not s.one_of:
            yield f"rule {rule} has a step without any condition"
        if s.capture == "":
            yield f"rule {rule} captures under no name"


def check_unique(rules: list[Rule]) -> list[Rule]:
    seen: set[str] = set()
    for r in rules:
        if r.id in seen:
            raise CatalogError(f"rule id {r.id} is given twice")
        seen.add(r.id)
    return rules


def load_builtin() -> list[Rule]:
    """The rules in this package, files in the order of their names."""
    files = sorted((f for f in resources.files("spanloom.catalogs").iterdir() if f.name.endswith(".toml")), key=lambda f: f.name)
    return check_unique([r for f in files for r in parse_toml(f.read_text("utf-8"), f.name, ("builtin", "Built-in rules"))])


def load_dir(path: str | Path, source: tuple[str, str] = ("filesystem", "Files")) -> list[Rule]:
    """The rules of all .toml files below a folder, links followed, in the order of their paths."""
    root = Path(path)
    if not root.is_dir():
        raise CatalogError(f"{root} is no folder")
    files = sorted(Path(d) / f for d, _, names in root.walk(follow_symlinks=True) for f in names if f.endswith(".toml"))
    return check_unique([r for f in files for r in parse_toml(f.read_text("utf-8"), str(f), source)])


def load_combined(local: str | Path | None = None) -> list[Rule]:
    """Built-in rules and those of a local folder, which may be missing."""
    rules = load_builtin()
    if local is not None and Path(local).exists():
        rules = rules + load_dir(local, ("local", "Local rules"))
    return check_unique(rules)


# ---------------------------------------------------------------------------------------------------


@dataclass
class Compiled:
    """Rows of the matcher's dimension tables; their sizes are those of the catalog, not of the data."""

    conjunctions: list[tuple]  # key, pred, *FIELDS
    key_fields: list[str]  # fields that keys are made of
    seg_steps: list[tuple]  # seg, offset, pred, length
    segs: list[tuple]  # form, seg_no, seg, length, gap_min, gap_max
    forms: list[tuple]  # form, vid, role, n_segs, spec, path, captures
    variants: list[tuple]
    most_segs: int
    empty_seg: int | None

    CONJUNCTION = "key string, pred int, surface string, pos1 string, pos2 string, conj_form string, base_form string"
    SEG_STEP = "seg int, offset int, pred int, length int"
    SEG = "form int, seg_no int, seg int, length int, gap_min int, gap_max int"
    FORM = "form int, vid int, role string, n_segs int, spec int, path array<int>, caps array<struct<name:string,seg:int,off:int,gap:int>>"
    VARIANT = (
        "vid int, rule_ord int, variant_ord int, rule_id string, variant_id string, rule_name string, jlpt string, meaning_en string, hint string, sense_id string,"
        " ambiguity_group string, source_id string, source_label string, priority int, fallback boolean, left_boundary string, right_boundary string, absorb boolean,"
        " wildcard_steps int, optional_steps int, has_left boolean, has_right boolean, left_of int, right_of int"
    )

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        rows, schema = {
            "conjunctions": (self.conjunctions, self.CONJUNCTION),
            "seg_steps": (self.seg_steps, self.SEG_STEP),
            "segs": (self.segs, self.SEG),
            "forms": (self.forms, self.FORM),
            "variants": (self.variants, self.VARIANT),
        }[name]
        return spark.createDataFrame(rows, schema)


def _free(steps: list[Step]) -> bool:
    """Whether a context always matches with nothing: gaps from 0 without captures."""
    return all(s.gap is not None and s.gap[0] == 0 and not s.capture for s in steps)


def compile_rules(rules: list[Rule]) -> Compiled:
    """The tables for rules; rule_ord and variant_ord are positions in the list."""
    preds: dict[tuple, int] = {}
    conjunctions: list[tuple] = []
    segments: dict[tuple[int, ...], int] = {}
    out = Compiled([], [], [], [], [], [], 0, None)

    def pred_of(step: Step) -> int:
        conj = step.conjunctions()
        key = tuple(sorted(tuple(sorted(c.items())) for c in conj))
        if key not in preds:
            preds[key] = len(preds)
            for c in conj:
                by = next(f for f in SELECTIVE if f in c)
                conjunctions.append((f"{by}={c[by]}", preds[key], *[c.get(f) for f in FIELDS]))
                if by not in out.key_fields:
                    out.key_fields.append(by)
        return preds[key]

    def add_forms(vid: int, role: str, steps: list[Step]) -> None:
        optional = [i for i, s in enumerate(steps) if s.optional and s.gap is None]
        for skipped in itertools.product((0, 1), repeat=len(optional)):
            skip = {i for i, x in zip(optional, skipped) if x}
            segs: list[list[int]] = [[]]
            gaps: list[tuple[int, int]] = []
            path, caps, spec = [], [], 0
            for i, s in enumerate(steps):
                if s.gap is not None:
                    gaps.append(s.gap)
                    segs.append([])
                    path.append(-len(gaps))  # -k stands for the width of gap k - 1
                    if s.capture:
                        caps.append((s.capture, len(segs) - 2, len(segs[-2]), len(gaps) - 1))
                elif i in skip:
                    path.append(1)
                else:
                    path.append(0)
                    spec += s.specificity
                    if s.capture:
                        caps.append((s.capture, len(segs) - 1, len(segs[-1]), -1))
                    segs[-1].append(pred_of(s))
            form = len(out.forms)
            for k, seg in enumerate(segs):
                key = tuple(seg)
                if len(key) > MOST_STEPS:
                    raise CatalogError(f"more than {MOST_STEPS} steps without a gap")
                if key not in segments:
                    segments[key] = len(segments)
                    out.seg_steps.extend((segments[key], o, p, len(key)) for o, p in enumerate(key))
                if not key:
                    out.empty_seg = segments[key]
                low, high = gaps[k - 1] if k else (0, 0)
                out.segs.append((form, k, segments[key], len(key), low, high))
            out.most_segs = max(out.most_segs, len(segs))
            out.forms.append((form, vid, role, len(segs), spec, path, caps))

    owners: dict[tuple[str, str], int] = {}  # equal contexts are looked for once, under the first variant that has them

    def owner(vid: int, role: str, steps: list[Step]) -> int | None:
        if not steps:
            return None
        first = owners.setdefault((role, repr(steps)), vid)
        if first == vid:
            add_forms(vid, role, steps)
        return first

    for rule_ord, rule in enumerate(rules):
        for variant_ord, v in enumerate(rule.effective()):
            vid = len(out.variants)
            every = [*v.left, *v.core, *v.right]
            left, right = ([] if _free(steps) else steps for steps in (v.left, v.right))
            out.variants.append(
                (vid, rule_ord, variant_ord, rule.id, v.id, rule.name, rule.jlpt, rule.meaning_en, rule.hint, v.sense_id, v.ambiguity_group, rule.source[0], rule.source[1], int(v.priority or 0), bool(v.fallback), v.left_boundary, v.right_boundary, v.absorb)
                + (sum(s.gap is not None for s in every), sum(s.optional for s in every), bool(left), bool(right), owner(vid, "left", left), owner(vid, "right", right))
            )
            add_forms(vid, "core", v.core)
    out.conjunctions = conjunctions
    return out
