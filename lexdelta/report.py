"""Self-contained HTML reports of comparisons, one a pair, rendered in the tasks that hold the pair's changes."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdelta.functions.kernels import word_diff_html

_STYLE = (
    "body{font:16px/1.5 Georgia,serif;max-width:62rem;margin:2rem auto;padding:0 1rem;color:#1d2430}h1{font-size:1.5rem}"
    "table{border-collapse:collapse;width:100%;margin:1rem 0}td,th{border-bottom:1px solid #d6dbe3;padding:.3rem .5rem;text-align:left}td.n{text-align:right;font-variant-numeric:tabular-nums}"
    "article{border:1px solid #d6dbe3;border-radius:6px;padding: .8rem 1rem;margin:1rem 0}del{background:#fbe3e0}ins{background:#dff3e3;text-decoration:none}.k{font:12px sans-serif;text-transform:uppercase;color:#5a6577}"
    "nav li{margin:.2rem 0}pre{white-space:pre-wrap;background:#f6f7f9;padding:1rem;border-radius:6px}mark{background:#dff3e3}.off{display:none}form{display:flex;gap:.5rem;margin:1rem 0}"
)
#: Shows the cards of a view that hold the words looked for (two characters at least), and hides groups without any.
_SCRIPT = (
    "const f=document.forms.view,show=()=>{const v=f.mode.value,q=f.find.value.trim().toLowerCase(),words=q.length>1?q:'';let n=0;"
    "for(const c of document.querySelectorAll('article')){const fits=v==='all'||v==='financial'&&c.dataset.money>0||v==='structural'&&c.dataset.type!=='modified';"
    "const on=fits&&(!words||c.textContent.toLowerCase().includes(words));c.classList.toggle('off',!on);n+=on}"
    "for(const s of document.querySelectorAll('section.group'))s.classList.toggle('off',!s.querySelector('article:not(.off)'));document.getElementById('shown').textContent=n};"
    "f.addEventListener('input',show);f.addEventListener('submit',e=>e.preventDefault());show()"
)
UNCATEGORIZED = "Uncategorized"


def _groups(changes: list[dict]) -> dict[str, list[dict]]:
    """Changes by the first part of their path, in the order first seen; those without a path last."""
    out: dict[str, list[dict]] = {}
    for c in changes:
        out.setdefault((c["path"]["v2"] or c["path"]["v1"] or [UNCATEGORIZED])[0], []).append(c)
    return dict(sorted(out.items(), key=lambda g: g[0] == UNCATEGORIZED))


def _full_bill(doc: dict) -> str:
    """The new version in full with the places of changes marked; of overlapping ones the first stays."""
    text = (doc.get("full_text") or {}).get("v2")
    if not text:
        return ""
    spots = sorted((s["start"], s["end"], c["id"]) for c in doc["changes"] if (s := (c["full_text_span"] or {}).get("v2")))
    out, at = [], 0
    for start, end, ident in spots:
        if start >= at:
            out += [html.escape(text[at:start]), f'<mark><a href="#{ident}" title="{ident}">{html.escape(text[start:end])}</a></mark>']
            at = end
    return f"<h2>Full text</h2><pre>{''.join(out)}{html.escape(text[at:])}</pre>"


def _outline(nodes: list[dict] | None) -> str:
    """The tree of the new version as nested lists, amounts beside their headings."""
    if not nodes:
        return ""
    return "<ul>" + "".join(f"<li>{html.escape(n['label'])}{' · ' + ', '.join(map(_money, n['own_amounts'])) if n['own_amounts'] else ''}{_outline(n['children'])}</li>" for n in nodes) + "</ul>"


def _money(v: int | None) -> str:
    return "—" if v is None else f"${v:,}" if v >= 0 else f"-${-v:,}"


def _delta(old: int, new: int) -> str:
    d = new - old
    share = f" ({d / old * 100:+.1f}%)" if old else ""
    return ("+" if d > 0 else "") + _money(d) + share


def render(doc: dict) -> str:
    """The report of one published document."""
    e = html.escape
    bill, v = doc["bill"], doc["versions"]
    name = " ".join(str(bill[k]) for k in ("congress", "type", "number") if bill.get(k))
    rows = [(c["id"], (c["path"]["v2"] or c["path"]["v1"] or ["(unknown)"])[-1], p) for c in doc["changes"] for p in c["amounts"]]
    money = "".join(f'<tr><td><a href="#{i}">{e(where)}</a></td><td class="n">{_money(p["old"])}</td><td class="n">{_money(p["new"])}</td><td class="n">{_delta(p["old"], p["new"])}</td></tr>' for i, where, p in rows)
    def card(c: dict) -> str:
        path = " &gt; ".join(map(e, c["path"]["v2"] or c["path"]["v1"] or ["(unknown)"]))
        old, new = c["text"]["old"], c["text"]["new"]
        body = word_diff_html(old, new) if old and new else None
        if body is None:
            body = (f"<del>{e(old)}</del>" if old else "") + (f"<ins>{e(new)}</ins>" if new else "")
        return f'<article id="{c["id"]}" data-type="{c["change_type"]}" data-money="{len(c["amounts"])}"><div class="k">{c["change_type"]}</div><h3>{path}</h3><p>{body}</p></article>'

    groups = _groups(doc["changes"])
    nav = "".join(f'<li><a href="#g{n}">{e(g)}</a> ({len(cs)})</li>' for n, (g, cs) in enumerate(groups.items(), 1))
    cards = "".join(f'<section class="group" id="g{n}"><h2>{e(g)}</h2>{"".join(map(card, cs))}</section>' for n, (g, cs) in enumerate(groups.items(), 1))
    counts = " · ".join(f"{n} {k}" for k, n in doc["summary"].items())
    table = f"<h2>Money</h2><table><tr><th>Where</th><th>Old</th><th>New</th><th>Change</th></tr>{money}</table>" if rows else ""
    outline = _outline((doc.get("tree") or {}).get("v2"))
    modes = "".join(f'<label><input type="radio" name="mode" value="{m}"{" checked" * (m == "all")}> {m}</label>' for m in ("all", "financial", "structural"))
    data = json.dumps(doc, ensure_ascii=False).replace("</", "<\\/")
    return (
        f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{e(name)}</title><style>{_STYLE}</style><h1>{e(name)}: {e(v["v1"]["label"])} to {e(v["v2"]["label"])}</h1>'
        f'<p>{counts}</p>{table}<form name="view">{modes}<input type="search" name="find" placeholder="Find in changes"><span><output id="shown"></output> shown</span></form><nav><ol>{nav}</ol></nav>{cards}'
        f'{"<details><summary>Outline</summary>" + outline + "</details>" if outline else ""}{_full_bill(doc)}<script type="application/json" id="comparison">{data}</script><script>{_SCRIPT}</script></html>'
    )


def reports(documents: DataFrame) -> DataFrame:
    """(pair_id, html) of ``contract.documents``."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"pair_id": b["pair_id"], "html": [render(json.loads(t)) for t in b["canonical"]]})

    kind = documents.schema["pair_id"].dataType.simpleString()
    return documents.select("pair_id", "canonical").where(F.col("canonical").isNotNull()).mapInPandas(run, f"pair_id {kind}, html string")
