"""The results of the core queries in SQL, for a second engine over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from rosterlake.functions import rules
from rosterlake.operators.expand import NODE_PREFIXES, PREFIXES
from rosterlake.operators.search import SLOTS
from rosterlake.operators.texts import MISSING, TEMPLATES
from rosterlake.operators.vectors import ASPECTS
from rosterlake.plans.query import QueryPlan
from rosterlake.sources.fixtures import with_views


ANY_CASE = "(?i)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(c: str, t: str) -> str:
    return f"coalesce(contains(lower({c}), {q(t)}), false)"


def in_text(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def first_class(x: str, classes: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {in_text(x, ws)} THEN {q(k)}" for k, ws in classes.items()) + " END"


def most_class(x: str, classes: dict[str, list[str]]) -> str:
    n = {k: "(" + "+".join(f"contains({x}, {q(w)})::INT" for w in ws) + ")" for k, ws in classes.items()}
    best = f"greatest({', '.join(n.values())})"
    return f"CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {v} = {best} THEN {q(k)}" for k, v in n.items()) + " END"


def rank_case(x: str, level: bool) -> str:
    words = " ".join(f"WHEN contains({x}, {q(w)}) THEN {n if level else q(w)}" for w, n in sorted(rules.SENIORITY.items(), key=lambda y: -len(y[0])))
    pats = " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {n if level else q(w)}" for p, w, n in rules.SENIORITY_PATTERNS)
    return f"CASE {words} {pats} ELSE {0 if level else 'NULL'} END"


def title_sql(c: str) -> str:
    x = f"lower(trim({c}))"
    for a, b in rules.TITLE_ABBREVIATIONS.items():
        x = f"regexp_replace({x}, {q(chr(92) + 'b' + a + chr(92) + 'b')}, {q(b)}, 'g')"
    x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s\-&/]', ' ', 'g')"
    return rf"coalesce(trim(regexp_replace({x}, '\s+', ' ', 'g')), '')"


def title_case_sql(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def lookup_sql(x: str, variants: dict[str, list[str]]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(v)} THEN {q(k)}" for v, k in {v: k for k, vs in variants.items() for v in vs}.items()) + " END"


def short_title_sql(c: str) -> str:
    return f"lower(trim({c}))"


def _search(p: QueryPlan, limit: int) -> str:
    words = [t for t, _ in p.terms]
    finance = any(t in words for t in rules.FINANCE_TRIGGERS)
    high, medium = [t for t, w in p.terms if w >= 0.8][:10], [t for t, w in p.terms if 0.5 <= w < 0.8][:8]
    parts = []
    if high:
        parts.append(" OR ".join(has(c, t) for t in high for c in ("current_position", "current_company", "industry", "function" if finance and t in rules.FINANCE_FIELD_TERMS else "skills")))
    if medium:
        parts.append(" OR ".join(has(c, t) for t in medium for c in ("current_position", "current_company", "industry")))
    if parts and finance:
        parts.append(" OR ".join(has(c, t) for c, ts in rules.FINANCE_GUARD.items() for t in ts))
    five: list[str | None] = [*words[:5], *[None] * 11]
    at, cases = 0, []
    for field, points in SLOTS:
        whens = []
        for n in points:
            t = five[at]
            at += 1
            whens.append(f"WHEN {has(field, t) if t is not None else field + ' IS NOT NULL'} THEN {n}")
        cases.append(f"CASE {' '.join(whens)} ELSE 0 END")
    cases.append("CASE WHEN graduation_year >= 2020 THEN 3 WHEN graduation_year >= 2015 THEN 2 WHEN graduation_year >= 2010 THEN 1 ELSE 0 END")
    return f"SELECT *, {' + '.join(cases)} AS relevance_score FROM enhanced_search_result WHERE {' AND '.join(f'({x})' for x in parts)} ORDER BY relevance_score DESC, graduation_year DESC NULLS FIRST, name NULLS FIRST, person_id LIMIT {limit}"


def _positive(text: str) -> str:
    head, tail = text.split(" ORDER BY ")
    return f"SELECT * FROM ({head}) z WHERE relevance_score > 0 ORDER BY {tail}"


def _rescored(p: QueryPlan, limit: int, k: int) -> str:
    f = lambda c: f"coalesce(lower({c}), '')"
    short = f"concat_ws(' ', {f('current_position')}, {f('current_company')}, {f('industry')})"
    strong = [t for t, w in p.terms if w >= 0.7]
    hits = "+".join(f"contains(txt, {q(t)})::INT" for t in strong)
    boost = "+".join(f"CASE WHEN contains(short, {q(t)}) THEN {w * x} ELSE 0.0 END" for d, w in p.domains.items() for part, x in (("companies", 0.3), ("roles", 0.2)) for t in rules.DOMAINS[d][part]) or "0.0"
    found = "list_filter([" + ", ".join(f"CASE WHEN contains(txt, {q(t)}) THEN {q(t)} END" for t in strong) + "], lambda x: x IS NOT NULL)"
    pos = "coalesce(" + ", ".join(f"CASE WHEN contains({f('current_position')}, {q(t)}) THEN {q(f'position: {chr(39)}{t}{chr(39)}')} END" for t, _ in p.terms) + ", NULL)"
    com = "coalesce(" + ", ".join(f"CASE WHEN contains({f('current_company')}, {q(t)}) THEN {q(f'company: {chr(39)}{t}{chr(39)}')} END" for t, _ in p.terms) + ", NULL)"
    top = q("domain: " + max(p.domains, key=p.domains.get)) if p.domains else "NULL"
    return f"""WITH h AS ({_positive(_search(p, limit))}), t AS (SELECT *, {short} AS short, concat_ws(' ', {short}, {f('skills')}) AS txt FROM h),
    s AS (SELECT *, {found} AS sem, {hits} AS n, least({boost}, 0.5)::DOUBLE AS boost FROM t)
    SELECT person_id, relevance_score, round(least(1.0, (relevance_score / 50.0::DOUBLE * 0.6 + n / {float(max(len(p.terms), 1))}::DOUBLE * 0.4) * (1 + boost)), 6) AS final_score,
    CASE WHEN concat_ws('; ', {pos}, {com}, CASE WHEN n > 0 THEN 'semantic: ' || array_to_string(sem[1:2], ', ') END, {top}) = '' THEN 'general match' ELSE concat_ws('; ', {pos}, {com}, CASE WHEN n > 0 THEN 'semantic: ' || array_to_string(sem[1:2], ', ') END, {top}) END AS explanation
    FROM s ORDER BY final_score DESC, relevance_score DESC, graduation_year DESC NULLS FIRST, name NULLS FIRST, person_id LIMIT {k}"""


_SKILLS = "sk AS (SELECT person_id, list_sort(list(DISTINCT lower(trim(skill)))) AS l FROM skills WHERE skill IS NOT NULL AND trim(skill) <> '' GROUP BY 1), f AS (SELECT a.*, coalesce(sk.l, []) AS skill_list FROM alumni a LEFT JOIN sk USING (person_id))"
_METRICS = """, c AS (SELECT term, count(*) AS n FROM doc_terms GROUP BY 1), t AS (SELECT count(DISTINCT person_id)::DOUBLE AS total FROM doc_terms),
 p AS (SELECT a.term AS term1, b.term AS term2, count(*) AS n12 FROM doc_terms a JOIN doc_terms b ON a.person_id = b.person_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 5),
 pc AS (SELECT p.*, x.n AS n1, y.n AS n2, total FROM p JOIN c x ON x.term = term1 JOIN c y ON y.term = term2, t)"""
_PLAIN = """, m AS (SELECT term1, term2, n12, n1, n2, log2(n12 * total / (n1 * n2)) AS pmi, CASE WHEN log2(n12 / total) <> 0 THEN log2(n12 * total / (n1 * n2)) / -log2(n12 / total) END AS npmi, n12 * total / (n1 * n2) AS lift,
 n12::DOUBLE / n1 AS confidence, n12::DOUBLE / n2 AS reverse_confidence FROM pc)"""
_TABLE = """, e AS (SELECT term1 AS term, term2 AS expansion, confidence AS weight, lift FROM m UNION ALL SELECT term2, term1, reverse_confidence, lift FROM m),
 x AS (SELECT term, expansion, weight, row_number() OVER (PARTITION BY term ORDER BY round(weight, 9) DESC, expansion)::INT AS rank FROM e WHERE lift >= 1.0 AND weight >= 0.05 QUALIFY rank <= 10)"""


def _overlap(as_of: date, least: float, extra: str = "") -> str:
    return f"""{with_views('stints')}, s AS (SELECT * FROM stints), o AS (SELECT a.person_id AS person1, b.person_id AS person2, a.company, greatest(a.start_date, b.start_date) AS overlap_start, least(a.end_date, b.end_date) AS overlap_end
 FROM s a JOIN s b ON a.company = b.company AND a.person_id < b.person_id AND a.start_date <= b.end_date AND a.end_date >= b.start_date),
 w AS (SELECT *, (overlap_end - overlap_start) / 30.44::DOUBLE AS months, greatest(0.0, (DATE '{as_of}' - overlap_end) / 365.25::DOUBLE) AS years_ago FROM o WHERE overlap_end > overlap_start),
 r AS (SELECT *, least(months / 12, 1.0::DOUBLE) AS base, CASE WHEN months < 3 THEN 0.3 WHEN months < 6 THEN 0.6 WHEN months >= 12 THEN 1.2 ELSE 1.0 END::DOUBLE AS dur, exp(-years_ago / 5.0) AS rec,
 CASE WHEN {in_text('lower(company)', rules.TIER1)} THEN 1.2 ELSE 1.0 END::DOUBLE AS tier FROM w WHERE months >= {least}), z AS (SELECT *, greatest(0.0, least(base * dur * rec * tier, 1.0)) AS final_score FROM r),
 b AS (SELECT person1, person2, max(final_score) AS final_score, arg_max(years_ago, (final_score, -years_ago)) AS years_ago FROM z GROUP BY 1, 2), y AS (SELECT person1 AS person, person2 AS other, final_score, years_ago FROM b UNION ALL SELECT person2, person1, final_score, years_ago FROM b){extra}"""


def _place() -> dict[str, str]:
    low = rf"regexp_replace(lower(trim(location)), {q(rules.COUNTRY_SUFFIX)}, '')"
    second = "trim(split_part(location, ',', 2))"
    states = "CASE lower(" + second + ") " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in rules.STATES.items()) + " END"
    out = {"city": "", "state": "", "country": "", "metro_area": ""}
    for name, state, cities in rules.METROS:
        hit = in_text(low, cities)
        city = "CASE " + " ".join(f"WHEN contains({low}, {q(x)}) THEN {q(x.title())}" for x in sorted(cities, key=lambda y: -len(y))) + " END"
        for k, v in (("city", city), ("state", q(state)), ("country", q("United States")), ("metro_area", q(name))):
            out[k] += f" WHEN {hit} THEN {v}"
    for name, country, variants in rules.ABROAD:
        hit = in_text(low, variants)
        for k, v in (("city", q(name)), ("state", "NULL"), ("country", q(country)), ("metro_area", "NULL")):
            out[k] += f" WHEN {hit} THEN {v}"
    for k, v in (("city", "trim(split_part(location, ',', 1))"), ("state", f"coalesce({states}, {second})"), ("country", f"CASE WHEN {states} IS NOT NULL THEN 'United States' END"), ("metro_area", "NULL")):
        out[k] += f" WHEN contains(location, ',') THEN {v}"
    return {k: f"CASE{v} END" for k, v in out.items()}


def statements(ask: QueryPlan, finance: QueryPlan, words: list[str], related: dict[str, float], as_of: date, year: int, vector: Callable[[int], list[float]]) -> dict[str, str]:
    low = "lower(current_title)"
    place = _place()
    cleaned = "lower(trim(current_company))"
    for pattern, by in rules.COMPANY_PATTERNS:
        cleaned = f"regexp_replace({cleaned}, {q(pattern)}, {q(by)}, 'g')"
    nt = title_sql("current_title")
    titled = f"(SELECT person_id, {nt} AS t FROM alumni WHERE current_title IS NOT NULL)"
    share = lambda x: "(" + "+".join(f"contains(coalesce(lower({x}), ''), {q(t)})::INT" for t in words) + f") / {float(len(words))}::DOUBLE"
    anywhere = lambda t: " OR ".join(f"contains(coalesce(lower({c}), ''), {q(t)})" for c in ("current_title", "current_company", "normalized_title", "skills"))
    cooc = "least((" + "+".join(f"CASE WHEN {anywhere(t)} THEN {c} ELSE 0.0 END" for t, c in related.items()) + f")::DOUBLE / {float(len(related))}, 1.0)"
    exact = f"({share('current_title')} * 0.4 + {share('current_company')} * 0.3 + {share('skills')} * 0.2)"
    hit = lambda c: "(" + " OR ".join(f"contains(coalesce(lower({c}), ''), {q(t)})" for t in words) + ")"

    def legacy(boost: float, extra: str = "0.0") -> str:
        skill = " OR ".join(f"contains(lower(s), {q(t)})" for t in words)
        total = f"CASE WHEN {hit('current_title')} THEN {10.0 * boost} ELSE 0 END + CASE WHEN {hit('current_company')} THEN 8.0 ELSE 0 END + CASE WHEN {hit('normalized_title')} THEN 6.0 ELSE 0 END + CASE WHEN {hit('normalized_company')} THEN 5.0 ELSE 0 END + len(list_filter(skill_list, lambda s: {skill})) * 2.0 + CASE WHEN {year} - graduation_year <= 10 THEN 2.0 * (10 - ({year} - graduation_year)) / 10 ELSE 0.0 END + {extra}"
        size = "length(concat(coalesce(current_title, ''), coalesce(current_company, ''), coalesce(normalized_title, '')))"
        return f"CASE WHEN {size} > 0 THEN ({total})::DOUBLE / ln(1.0 + {size}) ELSE ({total})::DOUBLE END"

    weight = lambda c: f"CASE split_part({c}, ':', 1) " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in rules.TERM_WEIGHTS.items()) + " ELSE 1.0 END"
    keep = "length(w) >= 2 AND w NOT IN (" + ", ".join(map(q, dict.fromkeys(rules.TEMPORAL_TERMS))) + r") AND NOT regexp_matches(w, '^[0-9]+$') AND length(regexp_replace(w, '[^\w\s]', '', 'g')) >= length(w) * 0.5"
    undated = lambda x: rf"lower(trim(regexp_replace({_fold(x, [(p, ' ') for p in rules.DATE_PATTERNS])}, '\s+', ' ', 'g')))"
    rule = {k: first_class(short_title_sql("current_title") if k != "industry_focus" else "lower(current_company)", c) for k, c in (("seniority", rules.RULES_SENIORITY), ("role_type", rules.RULES_ROLE), ("specialization", rules.RULES_SPECIALIZATION), ("department", rules.RULES_DEPARTMENT), ("industry_focus", rules.RULES_INDUSTRY))}
    gate = f"""WITH r AS (SELECT person_id, {', '.join(f'{v} AS {k}' for k, v in rule.items())} FROM alumni WHERE current_title IS NOT NULL),
      c AS (SELECT *, round(({' + '.join(f'CASE WHEN {k} IS NOT NULL THEN {w} ELSE 0 END' for k, w in rules.RULES_WEIGHTS.items())})::DOUBLE, 6) AS conf FROM r),
      g AS (SELECT person_id, {', '.join(rule)}, CASE WHEN conf >= 0.7 THEN conf ELSE greatest(conf, 0.1) END AS confidence, CASE WHEN conf >= 0.7 THEN 'rules' ELSE 'ai_fallback' END AS extraction_method FROM c)"""
    vec = lambda n: "[" + ", ".join(f"{x}::DOUBLE" for x in vector(n)) + "]"
    dd = "embedding::DOUBLE[]"
    held = lambda c: f"CASE WHEN trim({c}) <> '' THEN trim({c}) END"
    study = f"nullif(concat_ws(' ', {held('degree')}, {held('major')}, graduation_year::VARCHAR), '')"
    field = lambda c, x: f"coalesce({x}, {q(MISSING[c])})"
    say = {c: field(c, held(c)) for c in ("name", "current_title", "current_company", "location")} | {"education": field("education", study), "experience": q(MISSING["experience"]), "skills": field("skills", "nullif(array_to_string(skill_list[1:10], ', '), '')")}
    filled = lambda t, v: rf"trim(regexp_replace({' || '.join(v[p[1:]] if p.startswith('{') else q(p) for p in t.replace('{', '|{').replace('}', '|').split('|') if p)}, '\s+', ' ', 'g'))"
    role_text = f"nullif(concat_ws(' ', {held('current_title')}, 'at ' || {held('current_company')}, 'in ' || {held('location')}), '')"
    study_text = f"nullif(concat_ws(' ', {held('degree')}, 'in ' || {held('major')}, '(' || graduation_year || ')'), '')"
    skills_text = "CASE WHEN len(skill_list) > 0 THEN 'Skills and expertise: ' || array_to_string(skill_list[1:15], ', ') END"
    careers = with_views("profiles") + ", j AS (SELECT person_id, list(company ORDER BY start_date DESC, company DESC, title DESC) AS cs, list(title ORDER BY start_date DESC, company DESC, title DESC) AS ts, list(title || ' at ' || company ORDER BY start_date DESC, company DESC, title DESC) AS jobs FROM stints GROUP BY 1), c AS (SELECT p.*, cs, ts, jobs FROM profiles p LEFT JOIN j USING (person_id))"
    display = f"coalesce({place['metro_area']}, CASE WHEN {place['state']} IS NOT NULL THEN concat_ws(', ', {place['city']}, {place['state']}) END, CASE WHEN {place['country']} <> 'United States' THEN concat_ws(', ', {place['city']}, {place['country']}) END, {place['city']}, {title_case_sql('location')}, '')"
    bare_place = rf"regexp_replace(lower(trim(location)), {q(rules.COUNTRY_SUFFIX)}, '')"
    short_title = rf"trim(regexp_replace(regexp_replace(lower(trim(current_title)), '\b(the|a|an)\b', '', 'g'), '\s+', ' ', 'g'))"
    for a, b in rules.RULES_ABBREVIATIONS.items():
        short_title = f"regexp_replace({short_title}, {q(chr(92) + 'b' + a + chr(92) + 'b')}, {q(b)}, 'g')"
    skip = f"((split_part(term1, ':', 1) = split_part(term2, ':', 1) AND split_part(term1, ':', 1) <> 'title') OR list_sort([split_part(term1, ':', 1), split_part(term2, ':', 1)]) = ['company', 'location'] OR term1 IN ({', '.join(map(q, rules.GENERIC_TERMS))}) OR term2 IN ({', '.join(map(q, rules.GENERIC_TERMS))}))"
    hops = """, g AS (SELECT * FROM x WHERE rank <= 5), h1 AS (SELECT term AS start, expansion, max(weight * 0.5) AS w FROM g WHERE term <> expansion GROUP BY 1, 2),
          h2 AS (SELECT h1.start, g.expansion, max(h1.w * g.weight * 0.25) AS w FROM h1 JOIN g ON g.term = h1.expansion WHERE g.expansion <> h1.start GROUP BY 1, 2), u AS (SELECT start, expansion, w, 1 AS hop FROM h1 UNION ALL SELECT start, expansion, w, 2 FROM h2),
          best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY start, expansion ORDER BY w DESC, hop) = 1)"""
    ranked = f"CASE WHEN {rank_case('t', False)} IN ('manager', 'director') THEN 1.5 ELSE 0.0 END + CASE WHEN metro_area = 'New York City Metro' THEN 1.0 ELSE 0.0 END"
    percent = lambda x: f"printf('%.2f%%', round_even({x}, 4) * 100)"
    words_in = lambda c, w: f"coalesce(list_contains(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), {q(w)}), false)"
    stored = "e AS (SELECT person_id, embedding_data::VARCHAR AS j FROM multi_aspect_embeddings WHERE json_valid(embedding_data::VARCHAR)), a AS (" + " UNION ALL ".join(f"SELECT person_id, {q(x)} AS aspect, json_extract(j, '$.aspects.{x}') AS o FROM e" for x in ASPECTS) + "), s AS (SELECT person_id, aspect, o ->> '$.text' AS text, json_array_length(o, '$.embedding') AS dim FROM a WHERE o IS NOT NULL AND json_type(o) <> 'NULL')"
    return {
        "location_normalize": f"SELECT person_id, low, CASE WHEN location IS NULL OR location = '' THEN '' ELSE coalesce({lookup_sql('low', rules.LOCATION_VARIANTS)}, CASE WHEN contains(low, ',') THEN {lookup_sql('trim(split_part(low, chr(44), 1))', rules.LOCATION_VARIANTS)} END, {title_case_sql('location')}) END AS normalized FROM (SELECT person_id, location, {bare_place} AS low FROM alumni) z",
        "temporal_clean": f"SELECT doc_id, md5({undated('text')}) AS digest FROM documents WHERE text IS NOT NULL",
        "title_variations": rf"SELECT person_id, array_to_string(list_sort(list_distinct(list_filter([t, regexp_replace(t, 'software engineer', 'swe', 'g'), regexp_replace(t, 'product manager', 'pm', 'g'), trim(regexp_replace(t, '\b(senior|junior|lead|principal|staff)\b\s*', '', 'g')), regexp_replace(t, 'developer', 'engineer', 'g'), regexp_replace(t, 'engineer', 'developer', 'g')], lambda x: x <> ''))), '|') AS variations FROM {titled} z",
        "title_patterns": "SELECT person_id, " + ", ".join(f"array_to_string(list_sort(list_distinct(list_transform(flatten([{', '.join(f'regexp_extract_all(current_title, {q(ANY_CASE + p)}, 1)' for p in rules.QUERY_PATTERNS[k])}]), lambda x: lower(trim(x))))), '|') AS {k}" for k in ("titles", "seniority", "education")) + " FROM alumni WHERE current_title IS NOT NULL",
        "place_display": f"SELECT person_id, {display} AS display FROM alumni WHERE location IS NOT NULL",
        "record_fields": rf"SELECT person_id, coalesce(trim(regexp_replace(regexp_replace(current_title, '\s*[-–—]\s*', ' - ', 'g'), '\s+', ' ', 'g')), '') AS spaced, {short_title} AS short, CASE WHEN current_company IS NULL OR current_company = '' THEN '' ELSE coalesce({lookup_sql(cleaned, rules.COMPANY_VARIANTS)}, {title_case_sql(cleaned)}) END AS company FROM alumni",
        "term_documents_v1": f"""WITH p AS (SELECT *, {nt} AS t FROM alumni), r AS (SELECT person_id, 'company' AS k, normalized_company AS v FROM p UNION ALL SELECT person_id, 'title', t FROM p UNION ALL SELECT person_id, 'seniority', {rank_case('t', False)} FROM p UNION ALL SELECT person_id, 'role', {most_class('t', rules.ROLE_TYPES)} FROM p UNION ALL SELECT person_id, 'spec', {first_class('t', rules.SPECIALIZATIONS)} FROM p
          UNION ALL SELECT person_id, 'dept', {first_class('t', rules.DEPARTMENTS)} FROM p UNION ALL SELECT person_id, 'industry', {first_class('t', rules.INDUSTRY_FOCUS)} FROM p UNION ALL SELECT person_id, 'location', CASE WHEN location IS NOT NULL THEN {display} END FROM p UNION ALL SELECT person_id, 'skill', trim(skill) FROM skills WHERE person_id IN (SELECT person_id FROM alumni)),
          d AS (SELECT DISTINCT person_id, k || ':' || lower(v) AS term FROM r WHERE v <> '') SELECT term, count(*) AS n FROM d GROUP BY 1""",
        "profile_texts": f"WITH {_SKILLS} SELECT person_id, {', '.join(f'{filled(t, say)} AS {k}_text' for k, t in TEMPLATES.items())} FROM f",
        "aspect_texts": f"WITH {_SKILLS}, a AS (SELECT person_id, 'current_role' AS aspect, {role_text} AS text FROM f UNION ALL SELECT person_id, 'skills', {skills_text} FROM f UNION ALL SELECT person_id, 'education', {study_text} FROM f) SELECT * FROM a WHERE text IS NOT NULL",
        "profile_summaries": f"""WITH {_SKILLS}, a AS (SELECT person_id, {role_text} AS r, {skills_text} AS s, {study_text} AS e FROM f WHERE {role_text} IS NOT NULL OR len(skill_list) > 0 OR {study_text} IS NOT NULL)
          SELECT person_id, CASE WHEN s IS NOT NULL THEN concat_ws(' | ', r, CASE WHEN length(s) > 100 THEN s[1:100] || '...' ELSE s END) ELSE coalesce('Current: ' || r, '') END AS summary FROM a""",
        "experience_fanin": careers + " SELECT person_id, coalesce(len(cs), 0)::INT AS n, array_to_string(cs[1:3], '|') AS latest FROM c",
        "experience_texts": careers + " SELECT person_id, array_to_string(jobs[1:5], '. ') AS text FROM c WHERE len(jobs) > 0",
        "career_texts": careers + f" SELECT person_id, {filled(TEMPLATES['career_focused'], say | {'education': field('education', 'graduation_year::VARCHAR'), 'skills': q(MISSING['skills']), 'experience': field('experience', 'array_to_string(jobs[1:3], ' + q('; ') + ')')})} AS text FROM c",
        "past_employers": careers + " SELECT person_id, current_company, metro_area FROM c WHERE (current_company IN ('Supplier#000000001', 'Supplier#000000007') OR coalesce(list_has_any(cs, ['Supplier#000000001', 'Supplier#000000007']), false)) AND metro_area IN ('EUROPE', 'ASIA')",
        "experience_score": careers + """, s AS (SELECT person_id, CASE WHEN regexp_matches(lower(current_title), 'steel|brass') THEN 10.0 ELSE 0.0 END + CASE WHEN regexp_matches(lower(current_company), 'steel|brass') THEN 8.0 ELSE 0.0 END + coalesce(len(list_filter(ts, lambda t: regexp_matches(lower(t), 'steel|brass'))), 0) * 2.0 + CASE WHEN metro_area = 'EUROPE' THEN 1.0 ELSE 0.0 END
          + CASE WHEN 2000 - graduation_year <= 10 THEN 2.0 * (10 - (2000 - graduation_year)) / 10 ELSE 0.0 END AS t, length(concat(coalesce(current_title, ''), coalesce(current_company, ''))) AS n FROM c) SELECT person_id, round(CASE WHEN n > 0 THEN t::DOUBLE / ln(1.0 + n) ELSE t::DOUBLE END, 6) AS score FROM s""",
        "company_location_filter": f"WITH t AS (SELECT normalized_company FROM alumni WHERE trim(normalized_company) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), p AS (SELECT person_id, normalized_company, normalized_location, {place['city']} AS city, {place['metro_area']} AS metro_area FROM alumni), l AS (SELECT list(v) AS l FROM (SELECT normalized_location AS v FROM alumni WHERE trim(normalized_location) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) z) SELECT person_id, normalized_company, city, metro_area FROM p, l WHERE normalized_company IN (SELECT normalized_company FROM t) AND (coalesce(list_contains(l, metro_area), false) OR coalesce(list_contains(l, normalized_location), false) OR coalesce(list_contains(l, city), false))",
        "ranked_filters_score": f"WITH {_SKILLS}, g AS (SELECT *, {nt} AS t, {place['metro_area']} AS metro_area FROM f) SELECT person_id, round({legacy(1.0, ranked)}, 6) AS score FROM g",
        "paged_search": f"WITH {_SKILLS}, s AS (SELECT person_id, {legacy(1.0)} AS raw FROM f) SELECT person_id, round(raw, 6) AS score FROM s WHERE raw > 0 ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 20",
        "score_explanations": f"""WITH {_SKILLS}, g AS (SELECT *, array_to_string(skill_list, ' ') AS skills FROM f), s AS (SELECT person_id, {exact} AS e, {cooc} AS c, CASE WHEN {year} - graduation_year <= 10 THEN 0.2::DOUBLE * (10 - ({year} - graduation_year)) / 10 ELSE 0.0 END AS m FROM g), z AS (SELECT *, round_even(greatest(0.0, least(1.0, e * 0.4 + c * 0.3 + (1 - (e * 0.4 + c * 0.3)) * m * 0.5)), 4) AS fs FROM s)
          SELECT person_id, concat_ws(chr(10), 'Final Score: ' || {percent('fs')}, 'Score Components:', '  - Exact match score: ' || {percent('e')} || ' (weight: 40%)', '  - Co-occurrence match score: ' || {percent('c')} || ' (weight: 30%)', CASE WHEN m > 0 THEN 'Score Modifiers: +' || {percent('m')} END) AS explanation FROM z""",
        "widened_full_text": "SELECT person_id, current_title FROM alumni WHERE " + " OR ".join(words_in(c, w) for w in ("auditor", "analyst", "risk") for c in ("current_title", "normalized_title")),
        "cooccurrence_significant": with_views("doc_terms") + _METRICS + _PLAIN + f" SELECT term1, term2, n12, n1, n2, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi, round(lift, 6) AS lift, round(confidence, 6) AS confidence, round(reverse_confidence, 6) AS reverse_confidence FROM m WHERE lift > 1.0 AND confidence > 0.05 AND npmi > 0.0 AND NOT {skip}",
        "one_hop_expansion": with_views("doc_terms") + _METRICS + _PLAIN + _TABLE + f" SELECT expansion, round(w, 6) AS weight FROM (SELECT expansion, max(weight) AS w FROM x WHERE rank <= 5 AND term IN ({', '.join(q(p + 'building') for p in PREFIXES)}) GROUP BY 1) z ORDER BY w DESC, expansion LIMIT 5",
        "engine_expansion": with_views("doc_terms") + _METRICS + _PLAIN + _TABLE + hops + " SELECT start, expansion, round(w, 6) AS weight, hop FROM best WHERE w >= 0.03 QUALIFY row_number() OVER (PARTITION BY start ORDER BY round(w, 9) DESC, expansion) <= 20",
        "expansion_types": with_views("doc_terms") + _METRICS + _PLAIN + _TABLE + ", y AS (SELECT CASE WHEN contains(expansion, ':') THEN split_part(expansion, ':', 1) ELSE 'general' END AS type, regexp_replace(expansion, '^.*:', '') AS t, max(round(weight, 3)) AS s FROM x GROUP BY 1, 2) SELECT type, count(*) AS n, string_agg(t, '|' ORDER BY s DESC, t) AS terms FROM y GROUP BY 1",
        "term_nodes": with_views("doc_terms") + f", w AS (SELECT DISTINCT lower(trim(word)) AS word FROM (SELECT unnest(regexp_split_to_array(lower(current_title), '[^a-z0-9]+')) AS word FROM alumni UNION ALL SELECT unnest(['machinery', 'Europe', 'economy', 'building', 'skill:brand#11'])) z WHERE word <> ''), p AS (SELECT * FROM (VALUES {', '.join(f'({k}, {q(p)})' for k, p in enumerate(['', *NODE_PREFIXES]))}) v(k, p)), h AS (SELECT word, p || word AS node, k FROM w, p WHERE p || word IN (SELECT term FROM doc_terms) QUALIFY row_number() OVER (PARTITION BY word ORDER BY k) = 1) SELECT w.word, coalesce(node, w.word) AS node FROM w LEFT JOIN h USING (word)",
        "expansion_idf": with_views("doc_terms") + _METRICS + _PLAIN + _TABLE + ", b AS (SELECT regexp_replace(term, '^.*:', '') AS w, ln((1.0::DOUBLE + max(total)) / (1.0::DOUBLE + count(DISTINCT person_id))) + 1 AS idf FROM doc_terms, t GROUP BY 1) SELECT x.term, x.expansion, round(CASE WHEN idf IS NULL THEN weight ELSE weight * (0.5::DOUBLE + 0.5::DOUBLE * idf / (SELECT max(idf) FROM b)) END, 6) AS weight FROM x LEFT JOIN b ON b.w = regexp_replace(x.expansion, '^.*:', '')",
        "aspect_topk": f"WITH v AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 33, 48) AS v FROM embeddings) SELECT vec_id, round(list_dot_product(v, {vec(16)}) / sqrt(list_dot_product(v, v)), 6) AS score FROM v ORDER BY 2 DESC, 1 LIMIT 10",
        "stored_aspects": f"WITH {stored} SELECT person_id, aspect, count(*) AS n, max(dim)::INT AS dim, max(text) AS text FROM s GROUP BY 1, 2",
        "stored_aspects_by_id": f"WITH {stored} SELECT aspect, count(*) AS n FROM s WHERE person_id IN (SELECT person_id FROM alumni ORDER BY person_id LIMIT 500) GROUP BY 1",
        "weighted_like_search": f"SELECT person_id, name, graduation_year, relevance_score FROM ({_positive(_search(ask, 30))}) z",
        "finance_search": f"SELECT person_id, name, graduation_year, relevance_score FROM ({_positive(_search(finance, 30))}) z",
        "domain_rescore_topk": _rescored(ask, 30, 10),
        "profile_fanin_collect": f"WITH {_SKILLS} SELECT person_id, len(skill_list)::INT AS n_skills, array_to_string(skill_list, '|') AS skills FROM f",
        "skill_exists_semijoin": "SELECT person_id, graduation_year FROM alumni a WHERE EXISTS (SELECT 1 FROM skills s WHERE s.person_id = a.person_id AND lower(trim(s.skill)) = 'stakeholder management')",
        "entity_filters": f"SELECT person_id, s AS seniority, l AS seniority_level FROM (SELECT person_id, {rank_case('t', False)} AS s, {rank_case('t', True)} AS l FROM {titled}) z WHERE s IN ('manager', 'director', 'principal') AND l >= 5",
        "fulltext_all_terms": "SELECT person_id, current_title FROM alumni WHERE list_has_all(regexp_split_to_array(lower(current_title), '[^a-z0-9]+'), ['manager', 'marketing']) OR list_has_all(regexp_split_to_array(lower(normalized_title), '[^a-z0-9]+'), ['manager', 'marketing'])",
        "facets": f"""WITH m AS (SELECT normalized_company, {nt} AS t FROM alumni WHERE {has('current_title', 'manager')}), l AS (SELECT 'normalized_company' AS facet, normalized_company AS value FROM m UNION ALL SELECT 'seniority', {rank_case('t', False)} FROM m UNION ALL SELECT 'role_type', {most_class('t', rules.ROLE_TYPES)} FROM m),
          c AS (SELECT facet, value, count(*) AS n FROM l WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2) SELECT facet, value, n FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= CASE facet WHEN 'normalized_company' THEN 20 ELSE 10 END""",
        "suggestions": "SELECT * FROM (SELECT 'company: ' || current_company AS suggestion, count(*) AS n FROM alumni WHERE trim(current_company) <> '' GROUP BY current_company ORDER BY n DESC, current_company LIMIT 5) a UNION ALL SELECT * FROM (SELECT 'role: ' || current_title, count(*) AS n FROM alumni WHERE trim(current_title) <> '' GROUP BY current_title ORDER BY n DESC, current_title LIMIT 5) b",
        "normalized_score": f"""WITH {_SKILLS}, g AS (SELECT *, array_to_string(skill_list, ' ') AS skills FROM f), s AS (SELECT person_id, {exact} AS e, {cooc} AS c, CASE WHEN {year} - graduation_year <= 10 THEN 0.2::DOUBLE * (10 - ({year} - graduation_year)) / 10 ELSE 0.0 END AS m FROM g)
          SELECT person_id, round(e, 6) AS exact, round(c, 6) AS cooccurrence, round(round_even(greatest(0.0, least(1.0, e * 0.4 + c * 0.3 + (1 - (e * 0.4 + c * 0.3)) * m * 0.5)), 4), 3) AS final_score FROM s""",
        "legacy_score": f"WITH {_SKILLS} SELECT person_id, round({legacy(1.5)}, 6) AS score FROM f",
        "hybrid_merge": f"WITH {_SKILLS}, k AS (SELECT person_id, {legacy(1.0)} AS score FROM f), m AS (SELECT person_id, max(round(list_dot_product(embedding::DOUBLE[], {vec(384)}), 6)) AS sim FROM profile_embeddings WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY 1) SELECT person_id, round(score + coalesce(sim, 0) * 0.3, 6) AS score FROM k LEFT JOIN m USING (person_id) WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 50",
        "company_normalize_regex": f"SELECT person_id, {cleaned} AS cleaned FROM alumni",
        "record_hash_dedup": "SELECT person_id, h FROM (SELECT person_id, created_at, md5(lower(coalesce(name, '')) || '_' || coalesce(current_company, '') || '_' || coalesce(graduation_year::VARCHAR, '')) AS h FROM alumni) z QUALIFY row_number() OVER (PARTITION BY h ORDER BY created_at NULLS FIRST, person_id) = 1",
        "year_parse": r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(regexp_replace(text, '\s+', ' ', 'g'), '\b((?:19|20)\d{2})\b', 1), '') AS INT) AS year FROM documents",
        "upsert_touch": "SELECT c_custkey, c_name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'touched' ELSE 'old' END AS stamp FROM customer",
        "upsert_replace": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN upper(c_mktsegment) ELSE c_name END AS c_name, c_mktsegment FROM customer",
        "seniority_extract": f"SELECT person_id, {rank_case(low, False)} AS seniority, {rank_case(low, True)} AS level FROM alumni WHERE current_title IS NOT NULL",
        "role_type_argmax": f"SELECT person_id, {most_class(low, rules.ROLE_TYPES)} AS role_type FROM alumni WHERE current_title IS NOT NULL",
        "specialization_first_match": f"SELECT person_id, {first_class(low, rules.SPECIALIZATIONS)} AS specialization FROM alumni WHERE current_title IS NOT NULL",
        "title_entities": f"SELECT person_id, t AS normalized, {rank_case('t', False)} AS seniority, {rank_case('t', True)} AS seniority_level, {most_class('t', rules.ROLE_TYPES)} AS role_type, {first_class('t', rules.SPECIALIZATIONS)} AS specialization, {first_class('t', rules.DEPARTMENTS)} AS department, {first_class('t', rules.INDUSTRY_FOCUS)} AS industry_focus FROM {titled} z",
        "location_components": f"SELECT person_id, {', '.join(f'{v} AS {k}' for k, v in place.items())} FROM alumni WHERE location IS NOT NULL",
        "rule_confidence_gate": gate + " SELECT * FROM g",
        "extraction_stats": gate + " SELECT extraction_method, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg((role_type IS NOT NULL)::DOUBLE), 6) AS role_rate FROM g GROUP BY 1",
        "quality_report": "SELECT count(*) AS total, count(*) FILTER (WHERE current_company IS NULL OR trim(current_company) = '') AS missing_company, count(*) FILTER (WHERE current_title IS NULL OR trim(current_title) = '') AS missing_title, count(*) FILTER (WHERE graduation_year IS NULL) AS missing_year, (SELECT count(DISTINCT person_id) FROM skills) AS people_with_skills FROM alumni",
        "top_companies": "SELECT current_company AS value, count(*) AS n FROM alumni WHERE trim(current_company) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
        "year_distribution": "SELECT graduation_year, count(*) AS n FROM alumni WHERE graduation_year IS NOT NULL GROUP BY 1",
        "token_frequency": rf"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_split_to_array({nt}, '\s+'))) AS token FROM alumni WHERE trim(current_title) <> '') z WHERE token <> '' AND token NOT IN ({', '.join(map(q, rules.TITLE_STOPWORDS))}) GROUP BY 1",
        "temporal_term_filter": f"SELECT doc_id, count(*) AS n, count(DISTINCT w) AS n_distinct FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9-]+')) AS w FROM documents WHERE text IS NOT NULL) z WHERE {keep} GROUP BY 1",
        "term_documents_v2": rf"""WITH e AS (SELECT person_id, normalized_company, {nt} AS t FROM alumni WHERE current_title <> ''), v AS (SELECT person_id, 'title' AS p, unnest(regexp_split_to_array({undated('t')}, ' ')) AS w FROM e), r AS (SELECT person_id, p, w FROM v WHERE length(w) > 2
          UNION ALL SELECT person_id, 'seniority', {undated(rank_case('t', False))} FROM e UNION ALL SELECT person_id, 'role', {undated(most_class('t', rules.ROLE_TYPES))} FROM e UNION ALL SELECT person_id, 'spec', {undated(first_class('t', rules.SPECIALIZATIONS))} FROM e
          UNION ALL SELECT person_id, 'industry', {undated(first_class('t', rules.INDUSTRY_FOCUS))} FROM e UNION ALL SELECT person_id, 'company', {undated('normalized_company')} FROM e),
          d AS (SELECT DISTINCT person_id, p || ':' || w AS term FROM r WHERE w IS NOT NULL AND {keep}), b AS (SELECT person_id FROM d GROUP BY 1 HAVING count(*) >= 2), s AS (SELECT d.* FROM d JOIN b USING (person_id)),
          k AS (SELECT term FROM s GROUP BY 1 HAVING count(*) >= greatest(2, floor((SELECT count(*) FROM b) / 1000)))
          SELECT person_id, count(*) AS n, array_to_string(list_sort(list(term)), '|') AS terms FROM s JOIN k USING (term) GROUP BY 1""",
        "doc_frequency": with_views("doc_terms") + " SELECT term, count(*) AS df FROM doc_terms GROUP BY 1",
        "cooccurrence_pmi": with_views("doc_terms") + _METRICS + _PLAIN + " SELECT term1, term2, n12, n1, n2, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi, round(lift, 6) AS lift, round(confidence, 6) AS confidence, round(reverse_confidence, 6) AS reverse_confidence FROM m",
        "cooccurrence_weighted": with_views("doc_terms") + _METRICS + f""", k AS (SELECT *, n12 * ({weight('term1')} * {weight('term2')})::DOUBLE AS w12 FROM pc WHERE NOT ((split_part(term1, ':', 1) = split_part(term2, ':', 1) AND split_part(term1, ':', 1) <> 'title') OR list_sort([split_part(term1, ':', 1), split_part(term2, ':', 1)]) = ['company', 'location']))
          SELECT term1, term2, n12, n1, n2, round(ln(w12 * total / (n1 * n2)), 6) AS pmi, round(CASE WHEN ln(w12 / total) <> 0 THEN ln(w12 * total / (n1 * n2)) / -ln(w12 / total) END, 6) AS npmi, round(w12 * total / (n1 * n2), 6) AS lift, round(w12 / n1, 6) AS confidence, round(w12 / n2, 6) AS reverse_confidence FROM k""",
        "expansion_topk": with_views("doc_terms") + _METRICS + _PLAIN + _TABLE + " SELECT term, expansion, round(weight, 6) AS weight, rank FROM x",
        "term_associations": with_views("doc_terms") + _METRICS + _PLAIN + ", a AS (SELECT term1 AS term, term2 AS associated, pmi FROM m UNION ALL SELECT term2, term1, pmi FROM m) SELECT term, associated, round(pmi, 6) AS pmi FROM a WHERE term IN ('machinery', 'title:machinery', 'company:machinery', 'skill:machinery', 'role:machinery', 'industry:machinery') ORDER BY round(a.pmi, 9) DESC, associated LIMIT 10",
        "synonyms_cosine": with_views("doc_terms") + _METRICS + " SELECT term1, term2, round(n12 / sqrt(n1::DOUBLE * n2), 6) AS cosine FROM pc WHERE split_part(term1, ':', 1) = split_part(term2, ':', 1) AND n12 / sqrt(n1::DOUBLE * n2) >= 0.05",
        "tfidf_terms": """WITH d AS (SELECT doc_id, text FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(\\p{L}{2,})', 1)) AS term FROM d WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
          n AS (SELECT count(*) AS n FROM d), f AS (SELECT term, count(*) AS df, n FROM tf, n GROUP BY term, n HAVING count(*) >= 5 AND count(*) <= 0.8 * n ORDER BY df DESC, term LIMIT 10000)
          SELECT term, sum(tf)::BIGINT AS tf, round(sum(tf * ln((n + 1) / (df + 1))), 4) AS weight FROM tf JOIN f USING (term) GROUP BY 1""",
        "multi_hop_expansion": with_views("doc_terms") + _METRICS + _PLAIN + _TABLE + """, g AS (SELECT * FROM x WHERE rank <= 5), h1 AS (SELECT term AS start, expansion, max(weight * 0.5) AS w FROM g WHERE term <> expansion GROUP BY 1, 2),
          h2 AS (SELECT h1.start, g.expansion, max(h1.w * g.weight * 0.25) AS w FROM h1 JOIN g ON g.term = h1.expansion WHERE g.expansion <> h1.start GROUP BY 1, 2), u AS (SELECT start, expansion, w, 1 AS hop FROM h1 UNION ALL SELECT start, expansion, w, 2 FROM h2)
          SELECT start, expansion, round(w, 6) AS weight, hop FROM u QUALIFY row_number() OVER (PARTITION BY start, expansion ORDER BY w DESC, hop) = 1""",
        "colleague_overlap": _overlap(as_of, 0.0) + " SELECT company, count(*) AS n, round(sum(months), 4) AS months, min(overlap_start) AS first, max(overlap_end) AS last FROM r GROUP BY 1",
        "relationship_score": _overlap(as_of, 1.0) + " SELECT person1, count(*) AS n, round(sum(final_score), 4) AS score, round(max(final_score), 6) AS best FROM z GROUP BY 1",
        "connections": _overlap(as_of, 1.0) + " SELECT other, round(final_score, 6) AS score FROM y WHERE person = 1 AND final_score >= 0.3",
        "mutual_connectors": _overlap(as_of, 1.0) + " SELECT a.other AS connector, round((a.final_score + b.final_score) / 2, 6) AS score, round((a.years_ago + b.years_ago) / 2, 6) AS years_ago FROM y a JOIN y b ON a.other = b.other WHERE a.person = 1 AND b.person = 2",
        "career_lead": with_views("stints") + ", n AS (SELECT person_id, row_number() OVER w::INT AS position, company, title, end_date, lead(company) OVER w AS next_company, lead(title) OVER w AS next_title FROM stints WHERE start_date IS NOT NULL WINDOW w AS (PARTITION BY person_id ORDER BY start_date, company)) SELECT person_id, position::INT AS position, company, title, next_company, next_title FROM n WHERE end_date IS NOT NULL AND next_company IS NOT NULL".replace("row_number() OVER w::INT AS position", "row_number() OVER w AS position"),
        "transition_matrix": "WITH s AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events), n AS (SELECT event_type AS from_state, nx AS to_state, count(*) AS n FROM s WHERE event_type IS NOT NULL AND nx IS NOT NULL GROUP BY 1, 2) SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS p FROM n",
        "transition_patterns": with_views("stints") + ", s AS (SELECT company, end_date, lead(company) OVER (PARTITION BY person_id ORDER BY start_date, company) AS nx FROM stints WHERE start_date IS NOT NULL), n AS (SELECT company AS from_state, nx AS to_state, count(*) AS n FROM s WHERE nx IS NOT NULL AND end_date IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS p FROM n) SELECT from_state, to_state, n, round(p, 6) AS p FROM p WHERE n >= 5 ORDER BY n DESC, from_state, to_state LIMIT 20",
        "vector_topk": f"SELECT vec_id, round(list_dot_product({dd}, {vec(64)}), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10",
        "similar_items": "WITH q AS (SELECT vec_id AS item, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT item, vec_id, round(list_dot_product(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q WHERE vec_id <> item) SELECT item, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, vec_id) <= 10",
        "multi_aspect_topk": f"""WITH a AS (SELECT * FROM (VALUES ('current_role', 0, 0.4), ('experience', 1, 0.3), ('skills', 2, 0.2), ('education', 3, 0.1)) v(aspect, i, w)), l AS (SELECT vec_id, aspect, w::DOUBLE AS w, list_slice(embedding::DOUBLE[], 16 * i + 1, 16 * i + 16) AS v FROM embeddings, a),
          s AS (SELECT vec_id, aspect, w, list_dot_product(v, {vec(16)}) / sqrt(list_dot_product(v, v)) AS s FROM l) SELECT vec_id, round(sum(s * w) / sum(w), 6) AS score, coalesce(array_to_string(list_sort(list(aspect) FILTER (WHERE s > 0.5)), ','), '') AS matched FROM s GROUP BY 1 ORDER BY score DESC, vec_id LIMIT 10""",
    }


def _fold(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"regexp_replace({x}, {q(a)}, {q(b)}, 'g')"
    return x
