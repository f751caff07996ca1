"""A self-contained HTML page of a small graph (the nodes and edges of one query answer)."""

from __future__ import annotations

import html
import json
import math

PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif;margin:1em}}svg{{border:1px solid #ccc;width:100%;height:80vh}}line{{stroke:#999}}circle{{fill:#4a7}}text{{font-size:10px}}</style>
<h1>{title}</h1><p>{n} nodes, {m} edges <input id="q" placeholder="name"></p><svg viewBox="-520 -520 1040 1040">{body}</svg><script>const data={data};
document.getElementById("q").oninput=e=>document.querySelectorAll("g").forEach(g=>g.style.opacity=g.dataset.name.includes(e.target.value)?1:.15);</script>"""


def page(title: str, nodes: list[str], edges: list[dict]) -> str:
    """Nodes on a circle, edges as lines, and a name filter; the data is embedded as JSON."""
    at = {n: (480 * math.cos(2 * math.pi * i / max(1, len(nodes))), 480 * math.sin(2 * math.pi * i / max(1, len(nodes)))) for i, n in enumerate(nodes)}
    lines = "".join(f'<line x1="{at[e["src"]][0]:.1f}" y1="{at[e["src"]][1]:.1f}" x2="{at[e["dst"]][0]:.1f}" y2="{at[e["dst"]][1]:.1f}"/>' for e in edges if e["src"] in at and e["dst"] in at)
    marks = "".join(f'<g data-name="{html.escape(n, quote=True)}"><circle cx="{x:.1f}" cy="{y:.1f}" r="5"/><text x="{x:.1f}" y="{y:.1f}">{html.escape(n)}</text></g>' for n, (x, y) in at.items())
    data = json.dumps({"nodes": nodes, "edges": edges}).replace("</", "<\\/")
    return PAGE.format(title=html.escape(title), n=len(nodes), m=len(edges), body=lines + marks, data=data)
