"""The analysis document as Markdown and as a short text."""

from __future__ import annotations

from affinity.plans.insights import percent


def markdown(doc: dict, title: str = "Network report") -> str:
    o, out = doc["overview"], [f"# {title}", "", "## Overview", ""]
    out += [f"- Connections: {o['connections']:,}", f"- Employers: {o['distinct_companies']:,}", f"- Dated: {o['with_date']:,} ({o['first_connection'] or 'n/a'} to {o['last_connection'] or 'n/a'}, {o['span_days']:,} days)", ""]
    out += ["## Findings", ""] + [f"- **{i['title']}** ({i['confidence']}): {i['detail']}" for i in doc["insights"]] + [""]
    c = doc["companies"]
    out += ["## Employer concentration", ""]
    if c["available"]:
        out += ["| measure | value |", "|-|-|", *[f"| {k.replace('_', ' ')} | {'n/a' if v is None else v} |" for k, v in c["concentration"].items()], "", "| employer | connections |", "|-|-|", *[f"| {r['company']} | {r['count']} |" for r in c["largest"][:15]], ""]
    else:
        out += [c["reason"], ""]
    t = doc["temporal"]
    out += ["## Temporal dynamics", ""]
    if t["available"]:
        out += [f"- Active months: {t['active_months']} of {t['total_months']} ({percent(t['duty_cycle'])})", f"- Peak: {t['peak_month']['month']} ({t['peak_month']['count']})", f"- Half-life: {t['accumulation_half_life']} ({percent(t['half_life_elapsed_fraction'])} of the span)", f"- Bursts: {len(t['bursts'])}", f"- Pace: {t['velocity']['direction']}", ""]
    else:
        out += [t["reason"], ""]
    e = doc["eras"]
    out += ["## Eras", ""]
    if e["available"]:
        out += ["| era | connections | a month | terms |", "|-|-|-|-|", *[f"| {x['start']} to {x['end']} | {x['count']} | {x['rate_per_month']} | {', '.join(w['term'] for w in x['distinctive_terms'][:4])} |" for x in e["eras"]], ""]
    else:
        out += [e["reason"], ""]
    b, p = doc["structure"]["bipartite"], doc["structure"]["projection"]
    out += ["## Structure", "", f"- People {b['people']:,}, employers {b['companies']:,}, density {b['density']}", f"- Projection: {p['edges']:,} edges, {p['components']:,} components, mean degree {p['mean_degree']}", ""]
    return "\n".join([*out, f"_Schema {doc['schema_version']}; no names or addresses are part of this report._", ""])


def summary(doc: dict) -> str:
    o = doc["overview"]
    lines = [f"{o['connections']:,} connections, {o['distinct_companies']:,} employers, {o['span_days']:,} days"]
    return "\n".join(lines + [f"[{i['confidence']}] {i['title']}: {i['detail']}" for i in doc["insights"][:8]])
