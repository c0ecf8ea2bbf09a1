"""The result table as people see it."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions.numeric import display
from thalweg.sources.sinks import file_name, write_each

#: Columns in the order shown, with their headings and digits (None: text).
SHOWN = {
    "id": ("ID", None), "name": ("Name", None), "result": ("Result", None), "lat": ("Latitude", 3), "lng": ("Longitude", 3),
    "lat_snap": ("Snapped latitude", 3), "lng_snap": ("Snapped longitude", 3), "snap_dist": ("Snap distance, m", 0),
    "area_reported": ("Reported area, km²", 0), "area_calc": ("Computed area, km²", 0), "perc_diff": ("Difference, %", 0),
}


def viewer_table(summary: DataFrame) -> DataFrame:
    """Rows that did not fail, preferred columns first to last as far as present, all as text."""
    cols = [c for c in SHOWN if c in summary.columns]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if SHOWN[c][1] is None else display(F.col(c), SHOWN[c][1])
    return summary.where(F.col("result") != "failed").select(*[text(c).alias(c) for c in cols])


#: Base maps a reader may choose: name -> address of a tile.
BASE_MAPS = {
    "Streets": "https://tile.openstreetmap.org/{z}/{x}/{y}.png",
    "Relief": "https://a.tile.opentopomap.org/{z}/{x}/{y}.png",
    "None": "",
}
_STYLE = (
    "body{margin:0;font:14px sans-serif;display:flex;height:100vh}#l{overflow:auto;flex:1;padding:8px}#m{flex:1;position:relative;overflow:hidden;background:#eef}"
    "#m img,#m svg{position:absolute}#m svg{inset:0;width:100%;height:100%}#c{position:absolute;right:8px;top:8px;background:#fffc;padding:6px;z-index:2}"
    "#xy{position:absolute;left:8px;bottom:8px;background:#fffc;padding:2px 6px;z-index:2}th{cursor:pointer}tr.on{background:#dec}td,th{padding:2px 6px;text-align:left}"
)
#: Sorts and searches the table; draws the chosen row's layers, which are scripts beside the page, over base map tiles.
_SCRIPT = """
const $=i=>document.getElementById(i),t=$('t'),b=t.tBodies[0],m=$('m'),tiles=$('tiles'),svg=$('s');
$('q').oninput=e=>{for(const r of b.rows)r.hidden=!r.textContent.toLowerCase().includes(e.target.value.toLowerCase())};
[...t.tHead.rows[0].cells].forEach((h,i)=>{let up=1;h.onclick=()=>{const v=r=>{const x=r.cells[i].textContent,n=parseFloat(x.replace(/,/g,''));return isNaN(n)?x:n};
[...b.rows].sort((p,q)=>(v(p)>v(q)?1:-1)*up).forEach(r=>b.append(r));up=-up}});
let zoom=2,cx=0,cy=20,shown={basin:null,rivers:null},points=[];
const px=x=>(x+180)/360*256*2**zoom,py=y=>{const s=Math.sin(Math.max(-85,Math.min(85,y))*Math.PI/180);return(0.5-Math.log((1+s)/(1-s))/(4*Math.PI))*256*2**zoom};
const lng=p=>p/(256*2**zoom)*360-180,lat=p=>Math.atan(Math.sinh(Math.PI*(1-2*p/(256*2**zoom))))*180/Math.PI;
function at(x,y){return[px(x)-px(cx)+m.clientWidth/2,py(y)-py(cy)+m.clientHeight/2]}
function line(ps,close){return ps.map((p,i)=>(i?'L':'M')+at(p[0],p[1]).map(v=>v.toFixed(1)).join(' ')).join('')+(close?'Z':'')}
function draw(){const url=MAPS[$('base').value],w=m.clientWidth,h=m.clientHeight,z=Math.round(zoom),ox=px(cx)-w/2,oy=py(cy)-h/2;let html='';
if(url)for(let x=Math.floor(ox/256);x*256<ox+w;x++)for(let y=Math.max(0,Math.floor(oy/256));y*256<oy+h&&y<2**z;y++)
html+=`<img style="left:${x*256-ox}px;top:${y*256-oy}px" src="${url.replace('{z}',z).replace('{x}',((x%2**z)+2**z)%2**z).replace('{y}',y)}">`;
tiles.innerHTML=html;let g='';
if(shown.basin&&$('ob').checked)g+=`<path d="${shown.basin.geometry.coordinates.map(p=>p.map(r=>line(r,1)).join('')).join('')}" fill="#36c5" fill-rule="evenodd" stroke="#036"/>`;
if(shown.rivers&&$('or').checked)for(const f of shown.rivers.features)g+=`<path d="${line(f.geometry.coordinates)}" fill="none" stroke="#06f" stroke-width="${Math.sqrt(f.properties.ord)}"/>`;
points.forEach(([p,c])=>{if(p){const q=at(p[1],p[0]);g+=`<circle cx="${q[0]}" cy="${q[1]}" r="5" fill="${c}"/>`}});svg.innerHTML=g}
function load(file,done){const s=document.createElement('script');s.src=file;s.onload=done;s.onerror=()=>{};document.body.append(s)}
function fit(g){let x0=999,x1=-999,y0=999,y1=-999;g.coordinates.flat(2).forEach(p=>{x0=Math.min(x0,p[0]);x1=Math.max(x1,p[0]);y0=Math.min(y0,p[1]);y1=Math.max(y1,p[1])});
cx=(x0+x1)/2;cy=(y0+y1)/2;zoom=Math.max(1,Math.min(15,Math.floor(Math.log2(Math.min(m.clientWidth,m.clientHeight)*300/256/Math.max(x1-x0,y1-y0,1e-3)))))}
for(const r of b.rows)r.onclick=()=>{[...b.rows].forEach(o=>o.className='');r.className='on';const n=r.dataset.file;shown={basin:null,rivers:null};
load(n+'.js',()=>{shown.basin=basin;points=[[gage_coords,'#c00'],[snapped_coords,'#090']];fit(basin.geometry);draw()});if(RIVERS)load(n+'_rivers.js',()=>{shown.rivers=rivers;draw()})};
m.onwheel=e=>{e.preventDefault();zoom=Math.max(1,Math.min(17,zoom+(e.deltaY<0?1:-1)));draw()};
let drag=null;m.onmousedown=e=>{drag=[e.clientX,e.clientY]};onmouseup=()=>{drag=null};
m.onmousemove=e=>{const r=m.getBoundingClientRect();$('xy').textContent=lat(py(cy)+e.clientY-r.top-m.clientHeight/2).toFixed(4)+', '+lng(px(cx)+e.clientX-r.left-m.clientWidth/2).toFixed(4);
if(drag){const x=px(cx)-(e.clientX-drag[0]),y=py(cy)-(e.clientY-drag[1]);cx=lng(x);cy=lat(y);drag=[e.clientX,e.clientY];draw()}};
for(const i of['base','ob','or'])$(i).onchange=draw;onresize=draw;draw();
"""


def _open(spark, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)


def write_viewer(table: DataFrame, path: str, title: str = "Watersheds", rivers: bool = True) -> None:
    """A page with a sortable, searchable table (the batch's summary, a row per outlet) beside a map.

    A click on a row loads that watershed's layers (see write_layers) from the page's folder; boundary and rivers can
    be switched off, the base map chosen, and coordinates follow the mouse.
    """
    cols, out = table.columns, _open(table.sparkSession, path)
    say = lambda text: out.write(text.encode("utf-8"))
    head = "".join(f"<th>{html.escape(SHOWN[c][0])}</th>" for c in cols)
    say(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>{_STYLE}</style>")
    say(f"<div id=l><h1>{html.escape(title)}</h1><input id=q placeholder=Search><table id=t><thead><tr>{head}</tr></thead><tbody>")
    for row in table.select(*cols, file_name(F.col("id")).alias("_file")).toLocalIterator():
        say(f'<tr data-file="{html.escape(row["_file"])}">' + "".join(f"<td>{html.escape(row[c] or '')}</td>" for c in cols) + "</tr>")
    choice = "".join(f"<option>{html.escape(n)}</option>" for n in BASE_MAPS)
    say(f"</tbody></table></div><div id=m><div id=tiles></div><svg id=s></svg><div id=c><select id=base>{choice}</select> <label><input id=ob type=checkbox checked>Watershed</label> ")
    say(f"<label><input id=or type=checkbox checked>Rivers</label></div><div id=xy></div></div><script>const MAPS={json.dumps(BASE_MAPS)},RIVERS={json.dumps(rivers)};{_SCRIPT}</script>")
    out.close()


def write_layers(features: DataFrame, folder: str, name: str = "basin") -> int:
    """One script per row (id, geojson) in `folder`, which a page may load from a file; returns how many.

    Watersheds' scripts also tell where the outlet was (gage_coords) and where it was snapped to (snapped_coords), if
    the rows have lat, lng, lat_snap, lng_snap. Any two ids have different files; rivers' end in _rivers.
    """
    text = F.concat(F.lit(f"{name} = "), F.col("geojson"), F.lit(";"))
    if "lat_snap" in features.columns:
        at = lambda a, b: F.coalesce(F.to_json(F.array(a, b)), F.lit("null"))
        text = F.concat(F.lit("gage_coords = "), at("lat", "lng"), F.lit("; snapped_coords = "), at("lat_snap", "lng_snap"), F.lit("; "), text)
    return write_each(features.select("id", text.alias("text")), folder, ".js" if name == "basin" else f"_{name}.js")


def as_records(table: DataFrame) -> list[dict]:
    """The (small) display table as dictionaries."""
    return [json.loads(r) for r in table.toJSON().toLocalIterator()]
