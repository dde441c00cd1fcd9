"""A small depth-first model of the matcher, for tests only."""

from spanloom.functions.predicates import CLAUSE_MARKS, SENTENCE_MARKS


def step_matches(step, token):
    ok = lambda want: all(token.get(k, "") == v for k, v in want.items())
    return ok(step.fields) and (not step.one_of or any(map(ok, step.one_of)))


def runs(tokens, at, steps, spec=0, caps=()):
    """(end, spec, captures) of every way through steps, in order of search."""
    if not steps:
        yield at, spec, caps
        return
    step, rest = steps[0], steps[1:]
    if step.gap is not None:
        for n in range(step.gap[0], step.gap[1] + 1):
            if at + n > len(tokens) or any(t["surface"] in CLAUSE_MARKS for t in tokens[at : at + n]):
                return
            yield from runs(tokens, at + n, rest, spec, caps + (((step.capture, at, at + n - 1),) if step.capture and n else ()))
        return
    if at < len(tokens) and step_matches(step, tokens[at]):
        yield from runs(tokens, at + 1, rest, spec + step.specificity, caps + (((step.capture, at, at),) if step.capture else ()))
    if step.optional:
        yield from runs(tokens, at, rest, spec, caps)


def bounded(tokens, at, boundary):
    if boundary is None or not 0 <= at < len(tokens):
        return True
    return tokens[at]["surface"] in (CLAUSE_MARKS if boundary == "clause" else SENTENCE_MARKS)


def all_matches(tokens, rules):
    """Distinct candidates in listing order, as dicts."""
    out = []
    for rule in rules:
        for v in rule.effective():
            steps = [*v.left, *v.core, *v.right]
            gaps, optional = sum(s.gap is not None for s in steps), sum(s.optional for s in steps)
            for start in range(len(tokens)):
                if not bounded(tokens, start - 1, v.left_boundary):
                    continue
                left = (start, 0, ())
                if v.left:
                    found = [(spec, s, -k, caps) for s in range(start + 1) for k, (end, spec, caps) in enumerate(runs(tokens, s, v.left)) if end == start]
                    if not found:
                        continue
                    best = max(found, key=lambda x: x[:3])
                    left = (best[1], best[0], best[3])
                for end, spec, caps in runs(tokens, start, v.core):
                    if end <= start or not bounded(tokens, end, v.right_boundary):
                        continue
                    right = (0, ())
                    if v.right:
                        ways = list(runs(tokens, end, v.right))
                        if not ways:
                            continue
                        best = max(range(len(ways)), key=lambda k: (ways[k][1], ways[k][0], k))
                        right = (ways[best][1], ways[best][2])
                    out.append(
                        {
                            "rule_id": rule.id, "variant_id": v.id, "token_start": left[0] if v.absorb else start, "token_end": end - 1,
                            "captures": left[2] + caps + right[1], "fallback": bool(v.fallback), "core_specificity": spec,
                            "context_specificity": left[1] + right[0] + (v.left_boundary is not None) + (v.right_boundary is not None),
                            "priority": v.priority or 0, "wildcard_steps": gaps, "optional_steps": optional,
                            "sense_id": v.sense_id, "ambiguity_group": v.ambiguity_group, "discovery": len(out),
                        }
                    )
    seen, kept = set(), []
    for m in out:
        key = tuple(m[k] for k in ("rule_id", "variant_id", "token_start", "token_end", "captures", "fallback", "core_specificity", "context_specificity", "priority", "wildcard_steps", "optional_steps"))
        if key not in seen:
            seen.add(key)
            kept.append(m)
    return sorted(kept, key=identity)


def identity(m):
    return tuple(m[k] for k in ("token_start", "token_end", "rule_id", "variant_id", "core_specificity", "context_specificity", "wildcard_steps", "optional_steps", "discovery"))


def better(a, b):
    key = lambda m: (not m["fallback"], m["core_specificity"], m["context_specificity"], m["priority"], m["token_end"] - m["token_start"])
    return key(a) > key(b) or key(a) == key(b) and (a["rule_id"], a["variant_id"]) < (b["rule_id"], b["variant_id"])


def resolved(found):
    first = {}
    for m in sorted(found, key=lambda m: m["discovery"]):
        first.setdefault((m["rule_id"], m["variant_id"], m["token_start"]), m)
    span = lambda m: (m["token_start"], m["token_end"])

    def fold(rows, same):
        kept = []
        for m in rows:
            at = next((i for i, e in enumerate(kept) if span(e) == span(m) and same(e, m)), None)
            if at is None:
                kept.append(m)
            elif better(m, kept[at]):
                kept[at] = m
        return kept

    rows = fold(sorted(first.values(), key=identity), lambda e, m: e["rule_id"] == m["rule_id"] or e["sense_id"] is not None and e["sense_id"] == m["sense_id"])
    rows = fold(rows, lambda e, m: e["ambiguity_group"] is not None and e["ambiguity_group"] == m["ambiguity_group"])
    return sorted(rows, key=identity)
