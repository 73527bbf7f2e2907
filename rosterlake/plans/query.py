"""Understanding of free-text queries, on the driver: phrases, domains, expansion, weights, entities, filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from rosterlake.functions import rules


@dataclass
class QueryPlan:
    """What a text asks for; `terms` are (term, weight) in the order in which they count."""

    text: str
    phrases: list[str] = field(default_factory=list)
    domains: dict[str, float] = field(default_factory=dict)
    expanded: dict[str, float] = field(default_factory=dict)
    terms: list[tuple[str, float]] = field(default_factory=list)


def phrases_in(text: str) -> list[str]:
    """Canonical phrases found in the text, longest first; `finance_domain` marks finance queries."""
    low = text.lower()
    out = [rules.PHRASES[p] for p in sorted(rules.PHRASES, key=len, reverse=True) if p in low]
    if any(t in low for t in rules.FINANCE_PHRASE_HINTS):
        out.append("finance_domain")
    return list(dict.fromkeys(out))


def domains_of(text: str, phrases: list[str]) -> dict[str, float]:
    """Share of each domain in the weighted keyword hits of text and phrases."""
    low = " ".join([text, *phrases]).lower()
    raw = {d: sum(w * sum(t in low for t in spec[part]) for part, w in rules.DOMAIN_WEIGHTS.items()) for d, spec in rules.DOMAINS.items()}
    total = sum(raw.values())
    return {d: v / total for d, v in raw.items() if v} if total else {}


def expand(text: str, phrases: list[str], domains: dict[str, float]) -> dict[str, float]:
    """Synonyms of words (0.8) and of words of phrases (0.9), and primary terms of the domains (share * 0.7) if new."""
    out: dict[str, float] = {}
    for words, w in ((text.lower().split(), 0.8), ([x for p in phrases for x in p.split()], 0.9)):
        for x in words:
            out.update({s: w for s in rules.SYNONYMS.get(x, [])})
    for d, share in domains.items():
        for t in rules.DOMAINS[d]["primary"]:
            out.setdefault(t, share * 0.7)
    return out


def process(text: str) -> QueryPlan:
    """All steps; words longer than two letters weigh 1.0, phrases 1.0, words of phrases 0.9, expansions their own."""
    p = QueryPlan(text, phrases_in(text))
    p.domains = domains_of(text, p.phrases)
    p.expanded = expand(text, p.phrases, p.domains)
    weights: dict[str, float] = {w: 1.0 for w in text.lower().split() if len(w) > 2}
    for phrase in p.phrases:
        if phrase == "finance_domain":
            continue
        weights[phrase] = 1.0
        weights.update({w: 0.9 for w in phrase.split() if len(w) > 2 and w != phrase})
    for t, w in p.expanded.items():
        weights[t] = max(w, weights.get(t, 0.0))
    p.terms = list(weights.items())
    return p


def parse(text: str) -> dict:
    """Entities, constraints and keywords of a natural-language query, by patterns tried without regard to case."""
    low = text.lower()
    for a, b in rules.QUERY_ABBREVIATIONS.items():
        low = re.sub(rf"\b{a}\b", b, low)
    entities: dict[str, list] = {}
    for kind, patterns in rules.QUERY_PATTERNS.items():
        source = text if kind in ("companies", "locations") else low
        found = [m.strip() for p in patterns for m in re.findall(p, source, re.IGNORECASE)]
        entities[kind] = sorted({int(m) for m in found}) if kind == "experience_years" else sorted(set(found))
    constraints = sorted(k for k, p in rules.QUERY_CONSTRAINTS.items() if re.search(p, low, re.IGNORECASE))
    taken = " ".join(str(x) for v in entities.values() for x in v).lower()
    keywords = [w for w in low.split() if len(w) > 2 and w not in rules.QUERY_STOPWORDS and w not in taken]
    return {"entities": entities, "constraints": constraints, "keywords": keywords}


def request(text: str, expansions: list[tuple[str, float]] = (), limit: int = 20) -> dict:
    """Search request of a parsed query: terms, filters and boosts."""
    p = parse(text)
    e = p["entities"]
    terms = list(dict.fromkeys(x.lower() for x in [*e["titles"], *e["companies"], *p["keywords"], *(t.split(":", 1)[-1] for t, _ in list(expansions)[:10])]))
    filters = {"companies": e["companies"], "locations": e["locations"], "seniority_levels": e["seniority"]}
    if e["experience_years"]:
        filters["min_experience_years"] = min(e["experience_years"])
    filters |= {name: True for name, c in (("is_current_position", "current"), ("recent_only", "recent")) if c in p["constraints"]}
    boosts = {"title": 10.0, "company": 8.0, "expanded": 3.0, "skill": 2.0, "description": 1.0, "recency": 2.0, "seniority_level": 1.5}
    return {"terms": terms, "filters": {k: v for k, v in filters.items() if v}, "boosts": boosts, "limit": limit}


def words_of(text: str) -> list[str]:
    """Words of a query that are looked up in the term graph."""
    return [w for w in text.lower().replace(",", " ").replace(";", " ").split() if len(w) > 2 and w not in rules.GRAPH_STOPWORDS]


def explain_expansion(text: str, expanded: dict[str, float]) -> dict:
    """What a text was read as, and its expansions by type with scores to three places."""
    groups: dict[str, list[dict]] = {}
    for t, s in expanded.items():
        groups.setdefault(t.split(":")[0] if ":" in t else "general", []).append({"term": t.split(":")[-1], "score": round(s, 3)})
    return {"query": text, **parse(text), "expansions": groups}


def query_text(titles=(), companies=(), skills=(), locations=()) -> str:
    """The text of a structured query, for embedding."""
    parts = (("Role", titles), ("Company", companies), ("Location", locations), ("Skills", skills))
    return " ".join(f"{k}: {' '.join(v)}" for k, v in parts if v)
