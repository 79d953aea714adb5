from pyspark.sql import functions as F

from checks.c_grouping import (BAR, CENTERED, FREE, HH, OWNED, FRAG_V, MINH, MW, AW, AH, OX, OY, OUTSIDE, PROX, chain_sql, closure_sql, fold_union_sql,
                               keep_first_sql, ruby_gap_sql, smear_sql, width_sql, _side)
from checks.c_joins import assign_sql, plain
from checks.c_projections import CUTS, H, W, _side as cut_side, cuts
from checks.c_rounds import rounds_sql, trim_sql
from checks.registry import query
from checks.sqlgeo import *
from pagelattice.operators import grouping as GR
from pagelattice.plans import layout as L


def pre(sql, p, names):
    """Rename helper tables so that one statement can hold several of them."""
    import re
    for n in names.split():
        sql = re.sub(rf"\b{n}\b", p + n, sql)
    return sql


SEAM = f"""
so AS (SELECT page_id, region_id, list({{'l':l,'t':t,'r':r,'b':b,'n':n_boxes}} ORDER BY {cx('chains')}, strip, chain) AS xs FROM chains GROUP BY ALL),
sw AS (SELECT page_id, region_id, 1 AS i, xs FROM so UNION ALL SELECT page_id, region_id, i+1, CASE WHEN xs[i].r>xs[i+1].l THEN list_transform(xs, lambda k, j: CASE WHEN j=i THEN {{'l':k.l,'t':k.t,'r':(xs[i].r+xs[i+1].l)//2,'b':k.b,'n':k.n}}
 WHEN j=i+1 THEN {{'l':(xs[i].r+xs[i+1].l)//2,'t':k.t,'r':k.r,'b':k.b,'n':k.n}} ELSE k END) ELSE xs END FROM sw WHERE i<len(xs)),
seamed AS (SELECT page_id, region_id, k.l AS l, k.t AS t, k.r AS r, k.b AS b, k.n AS n_boxes FROM (SELECT page_id, region_id, unnest(xs) AS k FROM sw WHERE i=len(xs)))"""

EXTRACT = pre(keep_first_sql("regions", "region_id", "region_id", cont_over("a", "b", 60)), "env_", "ranked clash scan kept") + f""",
placed AS (SELECT x.*, (SELECT min(g.region_id) FROM env_kept g WHERE g.page_id=x.page_id AND {holds('g','x')}) AS region_id FROM boxes x),
inb AS (SELECT page_id, region_id, box_id, l,t,r,b FROM placed WHERE region_id IS NOT NULL),""" + ruby_gap_sql("inb") + f""",
stray AS (SELECT page_id, box_id, l,t,r,b FROM placed WHERE region_id IS NULL),
""" + closure_sql("stray", "box_id", f"{gx('a','b')}*10<=greatest({_side('a')},{_side('b')})*25 AND {gy('a','b')}*10<=greatest({_side('a')},{_side('b')})*25") + """,
frames AS (SELECT page_id, region_id, l, r FROM env_kept UNION ALL SELECT page_id, -1-cluster_id, min(l), max(r) FROM comp JOIN stray USING (page_id, box_id) GROUP BY page_id, cluster_id),
allb AS (SELECT page_id, region_id, box_id, l,t,r,b FROM ruby_done UNION ALL SELECT page_id, -1-cluster_id, box_id, l,t,r,b FROM comp JOIN stray USING (page_id, box_id)),
fb AS (SELECT a.*, f.l AS gl, f.r AS gr FROM allb a JOIN frames f USING (page_id, region_id)),""" + smear_sql("fb") + "," + chain_sql("pieces") + "," + SEAM


@query("extract_lines", uses="boxes regions", also=EXTRACT, sql=f"""
SELECT page_id, CASE WHEN region_id>=0 THEN 'BUBBLED' ELSE 'ORPHAN' END AS category, l, t, r, b, n_boxes, region_id, {cy('s')}//200 AS band FROM seamed s""")
def _(t):
    d = L.extract_lines(plain(t), t.regions, W, H)
    return d.withColumn("band", F.floor(F.shiftright(F.col("t") + F.col("b"), 1) / 200)).drop("reading_order")


@query("extract_lines_order", uses="boxes regions", also=EXTRACT, sql=f"""
SELECT page_id, region_id, l, t, row_number() OVER (PARTITION BY page_id ORDER BY {cy('s')}//200, -{cx('s')}, t, region_id, l, r) AS reading_order FROM seamed s""")
def _(t):
    return L.extract_lines(plain(t), t.regions, W, H).select("page_id", "region_id", "l", "t", "reading_order")


GROUPS = CUTS.replace("FROM regions)", "FROM regions WHERE region_id%3=0)") + f""",
cand AS (SELECT * FROM lines WHERE category<>'SFX'),
lob AS (SELECT x.page_id, x.line_id, arg_min({{'g':c.region_id,'lobe':CASE WHEN {cut_side(cx('x'), cy('x'))}>=0 THEN 0 ELSE 1 END}}, c.region_id) AS m FROM cand x JOIN cuts c ON c.page_id=x.page_id AND {holds('c','x')} GROUP BY ALL),
used AS (SELECT c.* FROM cuts c WHERE EXISTS (SELECT 1 FROM cand x WHERE x.page_id=c.page_id AND {holds('c','x')})),
regular AS (SELECT * FROM regions g WHERE NOT EXISTS (SELECT 1 FROM used c WHERE c.page_id=g.page_id AND {inter('g','c')}*100>70*{area('g')})),
free AS (SELECT x.* FROM cand x WHERE NOT EXISTS (SELECT 1 FROM lob WHERE lob.page_id=x.page_id AND lob.line_id=x.line_id)),
bst AS (SELECT x.*, arg_min(g, [-{inter('x','g')}, g.region_id]) FILTER (WHERE {inter('x','g')}>0) AS g FROM free x LEFT JOIN regular g ON g.page_id=x.page_id GROUP BY ALL),
inn AS (SELECT *, g IS NOT NULL AND coalesce({holds('g','bst')} OR {inter('bst','g')}*100>=40*{area('bst')}, false) AS hit FROM (SELECT page_id, line_id, l,t,r,b, g FROM bst) bst),
rest AS (SELECT page_id, line_id, l,t,r,b FROM inn WHERE NOT hit),
mw AS (SELECT page_id, list_sort(list(greatest(r-l,10)))[count(*)//2+1] AS cw FROM cand GROUP BY page_id),
sized AS (SELECT * FROM rest JOIN mw USING (page_id)),
""" + closure_sql("sized", "line_id", OUTSIDE) + f""",
every AS (SELECT x.page_id, x.line_id, x.l,x.t,x.r,x.b, m.lobe AS kind, m.g AS unit, g.l AS gl, g.t AS gt, g.r AS gr, g.b AS gb FROM lob JOIN cand x USING (page_id, line_id) JOIN regions g ON g.page_id=lob.page_id AND g.region_id=m.g
 UNION ALL SELECT page_id, line_id, l,t,r,b, 2, g.region_id, g.l, g.t, g.r, g.b FROM inn WHERE hit UNION ALL SELECT page_id, line_id, l,t,r,b, 3, cluster_id, NULL, NULL, NULL, NULL FROM comp JOIN rest USING (page_id, line_id)),
gb0 AS (SELECT page_id, kind, unit, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, any_value(gl) AS gl, any_value(gt) AS gt, any_value(gr) AS gr, any_value(gb) AS gb, count(*) AS n_lines FROM every GROUP BY page_id, kind, unit),
gb1 AS (SELECT page_id, kind, unit, n_lines, CASE WHEN kind=3 THEN greatest(0,l-6) ELSE least(greatest(0,gl,l-10),l) END AS l, CASE WHEN kind=3 THEN greatest(0,t-6) ELSE least(greatest(0,gt,t-10),t) END AS t,
 CASE WHEN kind=3 THEN least(512,r+6) ELSE greatest(least(512,gr,r+10),r) END AS r, CASE WHEN kind=3 THEN least(800,b+6) ELSE greatest(least(800,gb,b+10),b) END AS b FROM gb0),
grouped AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {cy('gb1')}//250, -{cx('gb1')}, kind, unit) AS group_no FROM gb1)"""


def some_cuts(t):
    return cuts(t).where("region_id % 3 = 0")


@query("prepare_groups", uses="lines regions", also=GROUPS, sql="SELECT page_id, group_no, kind<3 AS is_bubble, l AS ul, t AS ut, r AS ur, b AS ub, n_lines FROM grouped")
def _(t):
    return L.group_table(L.prepare_groups(t.lines, t.regions, some_cuts(t)))


@query("prepare_groups_lines", uses="lines regions", also=GROUPS, sql=f"""
SELECT e.page_id, e.line_id, g.group_no, row_number() OVER (PARTITION BY e.page_id, e.kind, e.unit ORDER BY -{cx('e')}, e.t, e.line_id) AS line_order FROM every e JOIN grouped g ON g.page_id=e.page_id AND g.kind=e.kind AND g.unit=e.unit""")
def _(t):
    return L.prepare_groups(t.lines, t.regions, some_cuts(t)).select("page_id", "line_id", "group_no", "line_order")


JOB = pre(keep_first_sql("boxes", "box_id", "conf_m DESC, box_id", iou_over("a", "b", 35)), "nms_", "ranked clash scan kept") + """,
okr AS (SELECT * FROM regions WHERE r-l>=18 AND b-t>=22 AND (r-l)*(b-t)>=400),
""" + fold_union_sql("okr", 65) + """,
fr AS (SELECT page_id, k.id AS region_id, k.l AS l, k.t AS t, k.r AS r, k.b AS b FROM united),
""" + pre(assign_sql("nms_kept"), "", "").replace("JOIN regions g", "JOIN fr g") + """,
outb AS (SELECT page_id, box_id, l,t,r,b FROM assigned WHERE region_id IS NULL),
""" + width_sql("outb", 16, 50, "least(r-l,b-t)") + ",\nsized AS (SELECT * FROM outb JOIN units USING (page_id)),\n" + closure_sql("sized", "box_id", PROX) + f""",
hit AS (SELECT x.*, EXISTS (SELECT 1 FROM zones e WHERE e.page_id=x.page_id AND e.r-e.l>=14 AND e.b-e.t>=14 AND (({holds('e','x')} AND {inter('x','e')}*100>=35*{area('x')}) OR ({holds('e','x',6)} AND {inter('x','e')}*100>=40*{area('x')}) OR {inter('x','e')}*100>=55*{area('x')})) AS hit FROM outb x),
kinds AS (SELECT page_id, cluster_id, CASE WHEN bool_or(hit) THEN 'ORPHAN' ELSE 'SFX' END AS category FROM comp JOIN hit USING (page_id, box_id) GROUP BY ALL),
cats AS (SELECT page_id, box_id, 'BUBBLED' AS category, l,t,r,b, CAST(NULL AS BIGINT) AS cluster_id FROM assigned WHERE region_id IS NOT NULL UNION ALL SELECT page_id, box_id, category, l,t,r,b, cluster_id FROM comp JOIN outb USING (page_id, box_id) JOIN kinds USING (page_id, cluster_id))"""


@query("job_layout", uses="boxes regions zones", also=JOB, sql=f"""
SELECT page_id, count(*) FILTER (WHERE category='BUBBLED') AS n_bubbled, count(*) FILTER (WHERE category='ORPHAN') AS n_orphan, count(*) FILTER (WHERE category='SFX') AS n_sfx, count(DISTINCT cluster_id) AS n_clusters,
 first(box_id ORDER BY {cy('cats')}//200, -{cx('cats')}, box_id) FILTER (WHERE category='BUBBLED') AS first_box FROM cats GROUP BY page_id""")
def _(t):
    return L.layout_counts(t.boxes, t.regions, t.zones)


#: The job's lines, then its groups; helper tables of the groups get names of their own.
LAYOUT = JOB + f""",
lay_b AS (SELECT page_id, region_id, box_id, l,t,r,b FROM assigned WHERE region_id IS NOT NULL UNION ALL SELECT page_id, -1-cluster_id, box_id, l,t,r,b FROM comp JOIN outb USING (page_id, box_id)),
lay_f AS (SELECT page_id, region_id, l, r FROM fr UNION ALL SELECT page_id, -1-cluster_id, min(l), max(r) FROM comp JOIN outb USING (page_id, box_id) GROUP BY page_id, cluster_id),
fb AS (SELECT a.*, f.l AS gl, f.r AS gr FROM lay_b a JOIN lay_f f USING (page_id, region_id)),""" + smear_sql("fb") + "," + chain_sql("pieces") + "," + SEAM + f""",
llines AS (SELECT s.page_id, row_number() OVER (PARTITION BY s.page_id ORDER BY {cy('s')}//200, -{cx('s')}, s.t, s.region_id, s.l, s.r) AS line_id, coalesce(k.category,'BUBBLED') AS category, s.l, s.t, s.r, s.b
 FROM seamed s LEFT JOIN kinds k ON k.page_id=s.page_id AND k.cluster_id=-1-s.region_id),
""" + pre(GROUPS[:GROUPS.index("cand AS")] + GROUPS[GROUPS.index("cand AS"):].replace("FROM lines", "FROM llines").replace("FROM regions g", "FROM fr g").replace("JOIN regions g", "JOIN fr g"),
          "g_", "cand lob used regular free bst inn rest mw sized edges reach comp every gb0 gb1 grouped")


@query("job_layout_groups", uses="boxes regions zones lines", also=LAYOUT, sql="SELECT page_id, group_no, kind<3 AS is_bubble, l AS ul, t AS ut, r AS ur, b AS ub, n_lines FROM g_grouped")
def _(t):
    return L.group_table(L.layout_groups(t.boxes, t.regions, t.zones, some_cuts(t)))


@query("job_layout_text", uses="boxes regions zones lines", also=LAYOUT + f""",
lg AS (SELECT e.page_id, e.line_id, e.l, e.t, e.r, e.b, g.group_no, row_number() OVER (PARTITION BY e.page_id, e.kind, e.unit ORDER BY -{cx('e')}, e.t, e.line_id) AS line_order
 FROM g_every e JOIN g_grouped g ON g.page_id=e.page_id AND g.kind=e.kind AND g.unit=e.unit),
bt AS (SELECT x.page_id, x.box_id, x.t, 'n' || x.conf_m AS text, (SELECT min(y.line_id) FROM lg y WHERE y.page_id=x.page_id AND {holds('y', 'x')}) AS line_id FROM boxes x),
lt AS (SELECT page_id, line_id, string_agg(text, ' ' ORDER BY t, box_id) AS text FROM bt WHERE line_id IS NOT NULL GROUP BY ALL),
gt AS (SELECT page_id, group_no, string_agg(lt.text, ' ' ORDER BY line_order) AS text FROM lg JOIN lt USING (page_id, line_id) GROUP BY ALL)""", sql="""
SELECT g.page_id, g.group_no, kind<3 AS is_bubble, l AS ul, t AS ut, r AS ur, b AS ub, n_lines, coalesce(text, '') AS text FROM g_grouped g LEFT JOIN gt USING (page_id, group_no)""")
def _(t):
    return L.layout_text(t.boxes.withColumn("text", F.concat(F.lit("n"), F.col("conf_m"))), t.regions, t.zones, some_cuts(t))


BOXU = "SELECT page_id, {u} AS unit_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n FROM {src} GROUP BY page_id, {u}"
TIERS = f"""best AS (SELECT a.*, g.region_id AS own, {inter('a','g')} AS i, {area('a')} AS ba,
 greatest(least(a.r,least(512,g.r+8))-greatest(a.l,greatest(0,g.l-8)),0)*greatest(least(a.b,least(800,g.b+8))-greatest(a.t,greatest(0,g.t-8)),0) AS gi,
 row_number() OVER (PARTITION BY a.page_id,a.box_id ORDER BY {inter('a','g')} DESC, g.region_id) AS rn FROM boxes a JOIN regions g ON a.page_id=g.page_id AND {inter('a','g')}>0),
tier AS (SELECT *, CASE WHEN i*100>=70*ba THEN 'strong' WHEN i*100>=35*ba THEN CASE WHEN gi*100>=60*ba THEN 'grown' ELSE 'nearest' END END AS tier FROM best WHERE rn=1),
near AS (SELECT x.page_id, x.box_id, arg_min(g.region_id, (({cx('x')}-{cx('g')})*({cx('x')}-{cx('g')})+({cy('x')}-{cy('g')})*({cy('x')}-{cy('g')}))*CAST(1000000000 AS BIGINT)+g.region_id) AS nid FROM tier x JOIN regions g USING (page_id) WHERE x.tier='nearest' GROUP BY ALL),
tiered AS (SELECT t.page_id, t.box_id, t.l,t.t,t.r,t.b, CASE tier WHEN 'nearest' THEN nid ELSE own END AS region_id FROM tier t LEFT JOIN near n ON n.page_id=t.page_id AND n.box_id=t.box_id WHERE tier IS NOT NULL)"""

STRICT = f"{dcx('a','b')}<0.45*{MW} AND ({OX}>0.35*{MW} OR {dcx('a','b')}<0.3*{MW}) AND {gy('a','b')}<greatest(1.1*{AH},1.8*{AW})"
STRICT_LINES = pre(closure_sql("boxes", "box_id", STRICT), "st_", "edges reach comp") + ",\nslines AS (SELECT page_id, cluster_id AS box_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM st_comp JOIN boxes USING (page_id, box_id) GROUP BY page_id, cluster_id)"
#: Lines in reading order, under the names that boxes have.
READ = pre(EXTRACT, "ex_", "edges reach comp") + f""",
rl AS (SELECT page_id, CASE WHEN region_id>=0 THEN 'BUBBLED' ELSE 'ORPHAN' END AS category, l, t, r, b, row_number() OVER (PARTITION BY page_id ORDER BY {cy('s')}//200, -{cx('s')}, t, region_id, l, r) AS box_id FROM seamed s)"""


def outside_sql(src, out="ou"):
    """Units of outside lines in ``src``; ids are those of their clusters."""
    return pre("lin AS (SELECT *, box_id AS line_id FROM " + src + "),\n" + width_sql("lin", 10, 100000) + ",\nsized AS (SELECT * FROM lin JOIN units USING (page_id)),\n" + closure_sql("sized", "line_id", OUTSIDE), "o_", "lin units sized edges reach comp") + f""",
{out} AS (SELECT page_id, cluster_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n FROM o_comp JOIN o_lin USING (page_id, line_id) GROUP BY page_id, cluster_id)"""


LOBE = f"{gx('a','b')}<=1.4*{AW} AND {OY}>0 AND {OY}>=0.35*{MINH} AND NOT ((abs(a.t-b.t)>0.7*{MINH} AND abs(a.b-b.b)>0.7*{MINH}) OR {OY}<0.3*{MINH})"
PRESET_4 = READ + f""",
lo AS (SELECT * FROM (SELECT x.page_id, x.box_id AS line_id, x.l, x.t, x.r, x.b, (SELECT min(g.region_id) FROM regions g WHERE g.page_id=x.page_id AND {holds('g','x')}) AS region_id FROM rl x WHERE category='BUBBLED') WHERE region_id IS NOT NULL),
""" + pre(closure_sql("lo", "line_id", LOBE, ("page_id", "region_id")), "lo_", "edges reach comp") + """,
sf AS (SELECT * FROM rl WHERE category='ORPHAN'),
""" + outside_sql("sf")
PRESET_5 = f"""held AS (SELECT g.page_id, g.region_id, x.box_id AS line_id, {cy('x')} AS cy, x.t, x.b FROM regions g JOIN boxes x ON x.page_id=g.page_id AND {holds('g','x')} WHERE (g.b-g.t)>1.35*(g.r-g.l)),
nxt AS (SELECT *, lag(t) OVER w AS pt, lag(b) OVER w AS pb FROM held WINDOW w AS (PARTITION BY page_id, region_id ORDER BY cy, line_id)),
cut AS (SELECT page_id, region_id, (pb+t)//2 AS y FROM nxt WHERE t-pb>0 AND t-pb>0.4*((b-t)+(pb-pt))/2 QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY t-pb DESC, cy, line_id)=1),
j AS (SELECT g.*, CASE WHEN y>=t+20 AND y<b-20 THEN y END AS y FROM regions g LEFT JOIN cut USING (page_id, region_id)),
parts AS (SELECT page_id, region_id*3 AS region_id, l, t, r, b FROM j WHERE y IS NULL UNION ALL SELECT page_id, region_id*3+1, l, t, r, y FROM j WHERE y IS NOT NULL UNION ALL SELECT page_id, region_id*3+2, l, y, r, b FROM j WHERE y IS NOT NULL),
pl AS (SELECT x.*, (SELECT min(g.region_id) FROM parts g WHERE g.page_id=x.page_id AND {holds('g','x')}) AS region_id FROM boxes x),
outb AS (SELECT * FROM pl WHERE region_id IS NULL),
""" + width_sql("outb", 16, 50, "least(r-l,b-t)") + ",\nsized AS (SELECT * FROM outb JOIN units USING (page_id)),\n" + closure_sql("sized", "box_id", PROX)
UNITS_OUT = f"greatest(a.b-a.t,b.b-b.t)<=1.6*{HH} AND (({gx('a','b')}<0.85*{AW} AND {OY}>0.4*{HH}) OR ({gx('a','b')}<0.25*{AW} AND {gy('a','b')}<0.65*{AH})) AND {BAR}"
PRESET_3 = OWNED + """,
outb AS (SELECT * FROM owned WHERE region_id<0),
""" + closure_sql("outb", "box_id", UNITS_OUT) + """,
un AS (SELECT page_id, region_id AS unit_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n FROM owned WHERE region_id>=0 GROUP BY page_id, region_id
 UNION ALL SELECT * FROM (SELECT page_id, -1-cluster_id, greatest(min(l)-6,0) AS l, greatest(min(t)-6,0) AS t, least(max(r)+6,512) AS r, least(max(b)+6,800) AS b, count(*) AS n FROM comp JOIN boxes USING (page_id, box_id) GROUP BY page_id, cluster_id) WHERE r-l>=10 AND b-t>=10),
""" + rounds_sql("un", "unit_id", "l, t, r, b, n", f"{inter('a','b')}>0 AND {inter('a','b')}*100>12*{min_area('a','b')}", [f"-{inter('a','b')}"], "min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, CAST(sum(n) AS BIGINT) AS n") + ",\n" + trim_sql("fin", "unit_id", ", n")
TIERED = TIERS.replace("FROM boxes", "FROM rl")
ALIKE = f"{inter('a','b')}>0 AND ({inter('a','b')}*100>45*({area('a')}+{area('b')}-{inter('a','b')}) OR {inter('a','b')}*100>85*{min_area('a','b')})"


def alike_sql(inner):
    """Lines by tiers as units ``inner``, the others in clusters, joined where they are alike."""
    return READ + ",\n" + TIERED + inner + """,
sf AS (SELECT * FROM rl ANTI JOIN tiered USING (page_id, box_id)),
""" + outside_sql("sf") + """,
un AS (SELECT page_id, unit AS unit_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n FROM put GROUP BY page_id, unit UNION ALL SELECT page_id, -1-cluster_id, l, t, r, b, n FROM ou),
""" + rounds_sql("un", "unit_id", "l, t, r, b, n", ALIKE, [f"-{inter('a','b')}"], "min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, CAST(sum(n) AS BIGINT) AS n")


ENDS = "SELECT page_id, unit_id, l, t, r, b, n FROM fin"

PRESET_SQL = {
    0: dict(uses="boxes regions", also=STRICT_LINES + ",\n" + OWNED.replace("FROM boxes x", "FROM slines x") + ",\n" + closure_sql("owned", "box_id", f"{FREE} AND ({FRAG_V} OR {cont_over('a','b',20)})") + ",\nub AS (SELECT * FROM comp JOIN slines USING (page_id, box_id))",
            sql=BOXU.format(u="cluster_id", src="ub")),
    3: dict(uses="boxes regions zones", also=PRESET_3, sql="SELECT page_id, unit_id, CAST(l AS INT) AS l, CAST(t AS INT) AS t, CAST(r AS INT) AS r, CAST(b AS INT) AS b, n FROM z WHERE r-l>=10 AND b-t>=10"),
    4: dict(uses="boxes regions", also=PRESET_4, sql="""
SELECT page_id, cluster_id AS unit_id, greatest(min(l)-8,0) AS l, greatest(min(t)-8,0) AS t, least(max(r)+8,512) AS r, least(max(b)+8,800) AS b, count(*) AS n FROM lo_comp JOIN lo USING (page_id, region_id, line_id) GROUP BY page_id, region_id, cluster_id
UNION ALL SELECT page_id, cluster_id, l, t, r, b, n FROM ou"""),
    5: dict(uses="boxes regions", also=PRESET_5, sql="""
SELECT page_id, region_id AS unit_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n FROM pl WHERE region_id IS NOT NULL GROUP BY page_id, region_id
UNION ALL SELECT page_id, -1-cluster_id, min(l), min(t), max(r), max(b), count(*) FROM comp JOIN outb USING (page_id, box_id) GROUP BY page_id, cluster_id"""),
    7: dict(uses="boxes regions", also=alike_sql(",\nput AS (SELECT *, region_id AS unit FROM tiered)"), sql=ENDS),
    9: dict(uses="boxes regions", also=CUTS + ",\n" + alike_sql(f",\nput AS (SELECT x.*, x.region_id*2+CASE WHEN {holds('c','x')} AND {cut_side(cx('x'), cy('x'))}<0 THEN 1 ELSE 0 END AS unit FROM tiered x JOIN cuts c ON c.page_id=x.page_id AND c.region_id=x.region_id)"), sql=ENDS),
    1: dict(uses="boxes regions", also=OWNED + ",\n" + closure_sql("owned", "box_id", f"a.region_id=b.region_id AND ({FRAG_V} OR {cont_over('a','b',20)})") + ",\nub AS (SELECT * FROM comp JOIN boxes USING (page_id, box_id))", sql=BOXU.format(u="cluster_id", src="ub")),
    2: dict(uses="boxes regions", also=CENTERED + ",\n" + closure_sql("owned", "box_id", f"{FREE} AND ({dcx('a','b')}<0.55*{MW} OR {OX}>0.3*{MW}) AND {gy('a','b')}<=2.5*{AH}") + ",\nub AS (SELECT * FROM comp JOIN boxes USING (page_id, box_id))", sql=BOXU.format(u="cluster_id", src="ub")),
    6: dict(uses="boxes regions", also=TIERS, sql=BOXU.format(u="region_id", src="tiered")),
    8: dict(uses="boxes regions", also=CUTS + ",\n" + TIERS + f",\ncutb AS (SELECT x.*, x.region_id*2+CASE WHEN {holds('c','x')} AND {cut_side(cx('x'), cy('x'))}<0 THEN 1 ELSE 0 END AS unit FROM tiered x JOIN cuts c ON c.page_id=x.page_id AND c.region_id=x.region_id)", sql=BOXU.format(u="unit", src="cutb")),
}


def _preset(m):
    @query(f"method_presets_{m}", **PRESET_SQL.get(m, {}))
    def _(t):
        return L.layout(plain(t), t.regions, m, cuts=cuts(t), gutters=t.zones.select("page_id", F.col("l").alias("gutter_x"), F.col("t").alias("gutter_y")))


for _m in L.PRESETS:
    _preset(_m)
