"""Questions in words: a rule-based router to the catalog, a narrator that only counts, and the way from one to the other.

Both are functions that a service can take the place of; what they may say comes from the catalog and the rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from terrace.operators.compare import Engine

#: Rows that a narrator gets to see, and characters of facts.
MOST_ROWS, MOST_CHARS = 200, 12_000

#: What a question has to hold for a query, the most telling first.
RULES = (
    ("migration_diff", r"migrat|move from|switch(?:ing)? from|that .* does(?: not|n't)"),
    ("extension_surface", r"extension|proprietary|vendor.specific|own (?:terms|concepts)"),
    ("gap_by_vendor", r"gap|missing|not (?:cover|map)|lack|unmapped"),
    ("convergence", r"converg|every vendor|all vendors|common to|shared by"),
    ("completeness_guard", r"complete|how much|how many|engaged"),
    ("coverage_by_capability", r"capabilit"),
    ("drill_down", r"drill|mappings? (?:of|for)|maps? to <?http"),
    ("coverage_by_object", r"cover|map"),
)

Router = Callable[[str, list[dict], list[dict]], dict]
Narrator = Callable[[str, str, list[dict], int], str]


def route(question: str, catalog: list[dict], vendors: list[dict]) -> dict:
    """{query, params, reason}; query is None where no rule fits or a parameter isn't named. vendors: prefix, namespace."""
    low = question.lower()
    named = sorted((m.start(), v["namespace"]) for v in vendors for m in [re.search(rf"\b{re.escape(v['prefix'].lower())}\b", low)] if m)
    spaces = [ns for _, ns in named]
    iri = re.search(r"https?://[^\s<>?\"']+", question)
    known = {q["name"]: q["params"] for q in catalog}
    for name, pattern in RULES:
        if name in known and re.search(pattern, low):
            have = {"FROM": spaces[0] if len(spaces) > 1 else None, "TO": spaces[1] if len(spaces) > 1 else None, "VENDOR": spaces[0] if spaces else "" if name == "extension_surface" else None, "REF_CONCEPT": iri[0] if iri else None}
            params = {p: have.get(p) for p in known[name]}
            if all(v is not None for v in params.values()):
                return {"query": name, "params": params, "reason": f"the question fits {name}"}
    return {"query": None, "params": {}, "reason": "no query of the catalog fits, or a vendor or concept isn't named"}


def narrate(question: str, query: str, rows: list[dict], total: int) -> str:
    """What the rows say, by count and first rows."""
    if not total:
        return f"{query}: no rows."
    shown = json.dumps(rows[:3], ensure_ascii=False)
    return f"{query}: {total} rows. First: {shown}"[:MOST_CHARS]


def answer(engine: Engine, question: str, router: Router = route, narrator: Narrator = narrate) -> dict:
    """Route, run, narrate; whatever fails is told in words, and which query ran is always said. MOST_ROWS rows reach the driver at most."""
    vendors = [{"prefix": p, "namespace": ns} for p, ns in engine.ctx.namespaces.items() if p != engine.ctx.reference]
    nothing = {"query": None, "params": {}, "rows": [], "count": 0}
    catalog = engine.list_queries()
    try:
        routing = router(question, catalog, vendors)
    except Exception as e:  # a service may fail in any way
        routing = {"query": None, "params": {}, "reason": f"router error: {e}"}
    name, params = routing.get("query"), routing.get("params") or {}
    if name not in {q["name"] for q in catalog}:
        return nothing | {"answer": f"No vetted query fits. {routing.get('reason', '')}".strip(), "routing": routing}
    try:
        rows = engine.to_rows(name, params, MOST_ROWS)
        count = len(rows) if len(rows) < MOST_ROWS else engine.run(name, params).count()
    except (KeyError, ValueError) as e:
        return nothing | {"answer": f"That query needs other parameters: {e}", "query": name, "params": params, "routing": routing}
    try:
        said = narrator(question, name, rows, count)
    except Exception as e:
        said = f"(narration error: {e})"
    return {"answer": said, "query": name, "params": params, "rows": rows, "count": count, "routing": routing}
