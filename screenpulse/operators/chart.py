"""One HTML page for a series: the answer as JSON inside it, drawn as inline SVG by a script of its own."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width">
<title>{title}</title>
<style>
:root{{color-scheme:light dark;--ink:#222;--soft:#8a8a8a;--dot:#3a6ea5;--line:#c8553d;--low:#c8553d33;--bar:#9ab}}
@media (prefers-color-scheme:dark){{:root{{--ink:#eee;--soft:#999;--dot:#7fb2e5;--line:#ff8a70;--low:#ff8a7033;--bar:#567}}}}
body{{font:16px/1.4 system-ui,sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem;color:var(--ink)}}
svg{{width:100%;display:block}}text{{fill:var(--soft);font-size:11px}}table{{border-collapse:collapse}}td,th{{padding:.1rem .6rem;text-align:right}}
</style></head><body>
<h1 id="name"></h1><p id="head"></p><div id="ratings"></div><div id="votes"></div>
<section id="past"><h2>History</h2><div id="page"></div></section>
<details><summary>Table</summary><table id="rows"></table></details><p id="credit"></p>
<script type="application/json" id="answer">{data}</script>
<script>
"use strict";
const a=JSON.parse(document.getElementById("answer").textContent),NS="http://www.w3.org/2000/svg";
const put=(id,t)=>{{document.getElementById(id).textContent=t}};
const el=(p,n,o,tip)=>{{const e=document.createElementNS(NS,n);for(const k in o)e.setAttribute(k,o[k]);if(tip){{const t=document.createElementNS(NS,"title");t.textContent=tip;e.append(t)}}p.append(e);return e}};
const scale=(a,b,c,d)=>x=>c+(x-a)/((b-a)||1)*(d-c);
put("name",a.series.title+" ("+a.series.years+")");put("head",a.verdict.headline+". "+a.verdict.reason);put("credit",a.credit);
const eps=a.episodes,label=e=>"S"+e[0]+"E"+e[1],at=new Map(eps.map((e,i)=>[label(e),i]));
const canvas=(id,h)=>{{const d=document.getElementById(id);d.replaceChildren();const w=d.clientWidth||800,s=el(d,"svg",{{viewBox:`0 0 ${{w}} ${{h}}`,height:h}});return [s,w]}};
function ratings(){{const h=260,[s,w]=canvas("ratings",h),x=scale(-.5,eps.length-.5,34,w-6),r=eps.map(e=>e[2]/10),lo=Math.floor(Math.min(...r)),y=scale(lo,10,h-18,6);
 for(let v=lo;v<=10;v++)el(s,"text",{{x:4,y:y(v)+4}}).textContent=v;
 for(const u of a.slumps){{const p=x(at.get(u.from)-.5),q=x(at.get(u.to)+.5);el(s,"rect",{{x:p,y:6,width:q-p,height:h-24,fill:"var(--low)"}},u.from+"–"+u.to+" "+u.delta)}}
 let last=null;for(const t of a.stretches){{const p=x(at.get(t.from)-.5),q=x(at.get(t.to)+.5),v=y(t.level);if(last!==null)el(s,"line",{{x1:p,x2:p,y1:last,y2:v,stroke:"var(--line)","stroke-dasharray":"2 3"}});el(s,"line",{{x1:p,x2:q,y1:v,y2:v,stroke:"var(--line)","stroke-width":2}},t.from+"–"+t.to+": "+t.level);last=v}}
 if(a.verdict.at){{const p=x(at.get(a.verdict.at)-.5);el(s,"line",{{x1:p,x2:p,y1:6,y2:h-18,stroke:"var(--ink)"}},a.verdict.at)}}
 eps.forEach((e,i)=>el(s,"circle",{{cx:x(i),cy:y(e[2]/10),r:3,fill:"var(--dot)"}},label(e)+": "+(e[2]/10).toFixed(1)+", "+e[3].toLocaleString()+" votes"))}}
function votes(){{const h=90,[s,w]=canvas("votes",h),x=scale(-.5,eps.length-.5,34,w-6),y=scale(0,Math.max(1,...eps.map(e=>e[3])),h-4,4),b=Math.max(1,(w-40)/eps.length-1);
 eps.forEach((e,i)=>el(s,"rect",{{x:x(i)-b/2,y:y(e[3]),width:b,height:h-4-y(e[3]),fill:"var(--bar)"}},label(e)+": "+e[3].toLocaleString()+" votes"))}}
function past(){{const p=a.history&&a.history.page;document.getElementById("past").hidden=!p||p.length<2;if(!p||p.length<2)return;
 const h=160,[s,w]=canvas("page",h),d=p.map(r=>Date.parse(r[0])/864e5),x=scale(d[0],d[d.length-1],34,w-6);
 for(const e of a.history.events){{const q=x(Date.parse(e.from)/864e5-.5),z=x(Date.parse(e.to)/864e5+.5);el(s,"rect",{{x:q,y:0,width:Math.max(2,z-q),height:h,fill:"var(--low)"}},e.summary)}}
 for(const [k,c] of [[1,"var(--dot)"],[2,"var(--bar)"]]){{const v=p.map(r=>r[k]),y=scale(Math.min(...v),Math.max(...v),h-6,6);let t="";d.forEach((q,i)=>{{t+=(i&&q-d[i-1]<=3?"L":"M")+x(q)+" "+y(v[i])}});el(s,"path",{{d:t,fill:"none",stroke:c,"stroke-width":1.5}})}}}}
function table(){{const t=document.getElementById("rows");for(const r of [a.episode_columns,...eps]){{const tr=t.insertRow();for(const c of r)tr.insertCell().textContent=c}}}}
const draw=()=>{{ratings();votes();past()}};draw();table();addEventListener("resize",draw);matchMedia("(prefers-color-scheme:dark)").addEventListener("change",draw);
</script></body></html>
"""


def write_page(answer: Mapping[str, Any], folder: Path) -> Path:
    """The page of an answer, swapped in when whole.  Every < of the JSON is escaped, so it can't close its script."""
    folder.mkdir(parents=True, exist_ok=True)
    data = json.dumps(answer, ensure_ascii=False).replace("<", "\\u003c")
    page = _PAGE.format(title=html.escape(f"{answer['series']['title']} · ratings"), data=data)
    target = folder / f"{answer['series']['id']}.html"
    part = target.with_suffix(".part")
    part.write_text(page, encoding="utf-8")
    os.replace(part, target)
    return target
