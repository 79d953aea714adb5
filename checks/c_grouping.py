from pyspark.sql import functions as F

from checks.c_joins import plain
from checks.c_projections import H, W
from checks.registry import query
from checks.sqlgeo import *
from pagelattice.functions import geometry as G
from pagelattice.operators.pagefold import hot_pages
from pagelattice.operators import grouping as GR, joins as J
from pagelattice.operators.filters import region_size

R4 = "l:=l, t:=t, r:=r, b:=b"


def keep_first_sql(src, row_id, order, clash, extra=""):
    """Per page: number the rows, list the clashes, and walk through the numbers keeping or dropping."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS k FROM {src}),
clash AS (SELECT a.page_id, a.k AS hi, b.k AS lo FROM ranked a JOIN ranked b ON a.page_id=b.page_id AND a.k<b.k AND {clash}),
scan AS (SELECT page_id, 0 AS step, CAST([] AS BIGINT[]) AS kept, max(k) AS n FROM ranked GROUP BY page_id
 UNION ALL SELECT s.page_id, s.step+1, CASE WHEN EXISTS (SELECT 1 FROM clash c WHERE c.page_id=s.page_id AND c.lo=s.step+1 AND list_contains(s.kept,c.hi)) THEN s.kept ELSE list_append(s.kept, s.step+1) END, s.n FROM scan s WHERE s.step<s.n),
kept AS (SELECT r.* FROM scan s JOIN ranked r ON r.page_id=s.page_id AND list_contains(s.kept, r.k) WHERE s.step=s.n)"""


def _nms(name, iou):
    @query(name, uses="boxes", also=keep_first_sql("boxes", "box_id", "conf_m DESC, box_id", iou_over("a", "b", iou)), sql="SELECT page_id, box_id FROM kept")
    def _(t):
        return GR.nms(t.boxes, iou).select("page_id", "box_id")


_nms("grp_nms", 35)
_nms("grp_nms_loose", 45)


@query("grp_nms_containment", uses="boxes", also=keep_first_sql("boxes", "box_id", "conf_m DESC, box_id", f"({iou_over('a','b',45)} OR {cont_over('a','b',70)})"), sql="SELECT page_id, box_id FROM kept")
def _(t):
    return GR.nms_containment(t.boxes).select("page_id", "box_id")


@query("grp_dedup_first", uses="boxes", also=keep_first_sql("boxes", "box_id", "box_id", cont_over("a", "b", 35)), sql="SELECT page_id, box_id FROM kept")
def _(t):
    return GR.dedup_first(t.boxes).select("page_id", "box_id")


@query("grp_dedup_first_lobes", uses="regions", also="marked AS (SELECT *, region_id%3=0 AS is_lobe FROM regions),\n" + keep_first_sql("marked", "region_id", "region_id", f"(NOT b.is_lobe AND {iou_over('a','b',40)})"), sql="SELECT page_id, region_id FROM kept")
def _(t):
    return GR.dedup_regions(t.regions.withColumn("is_lobe", F.col("region_id") % 3 == 0), 40).select("page_id", "region_id")


def fold_union_sql(src, pct):
    return f"""ordered AS (SELECT page_id, list({{'id':region_id,'l':l,'t':t,'r':r,'b':b}} ORDER BY region_id) AS xs FROM {src} GROUP BY page_id),
walk AS (SELECT page_id, 1 AS i, xs, xs[1:1] AS acc FROM ordered
 UNION ALL SELECT page_id, i+1, xs, CASE WHEN p IS NULL OR p=0 THEN list_append(acc, x) ELSE list_transform(acc, lambda k, j: CASE WHEN j=p THEN
  {{'id':k.id,'l':least(k.l,x.l),'t':least(k.t,x.t),'r':greatest(k.r,x.r),'b':greatest(k.b,x.b)}} ELSE k END) END
 FROM (SELECT *, xs[i+1] AS x, list_position(list_transform(acc, lambda k: {cont_over('k','xs[i+1]',pct)}), true) AS p FROM walk WHERE i<len(xs))),
united AS (SELECT page_id, unnest(acc) AS k FROM walk WHERE i=len(xs))"""


def _fold(name, pct):
    @query(name, uses="regions", also=fold_union_sql("regions", pct), sql="SELECT page_id, k.id AS region_id, k.l AS l, k.t AS t, k.r AS r, k.b AS b FROM united")
    def _(t):
        return GR.fold_union(t.regions, pct)


_fold("grp_fold_union", 65)
_fold("grp_fold_union_60", 60)
_fold("grp_fold_union_45", 45)


def closure_sql(src, row_id, near, keys=("page_id",)):
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c}=b.{c}" for c in keys)
    return f"""edges AS (SELECT {', '.join('a.' + c for c in keys)}, a.{row_id} AS u, b.{row_id} AS v FROM {src} a JOIN {src} b ON {on} AND a.{row_id}<>b.{row_id} AND ({near})),
reach AS (SELECT {k}, {row_id} AS u, {row_id} AS v FROM {src} UNION SELECT {', '.join('a.' + c for c in keys)}, a.u, b.v FROM reach a JOIN edges b ON {on} AND a.v=b.u),
comp AS (SELECT {k}, u AS {row_id}, min(v) AS cluster_id FROM reach GROUP BY ALL)"""


def width_sql(src, lo, hi, expr="greatest(r-l,0)", name="units"):
    return f"{name} AS (SELECT page_id, CAST(least(greatest(list_sort(list({expr}))[count(*)//2+1],{lo}),{hi}) AS INT) AS cw FROM {src} GROUP BY page_id)"


MINH = "least(a.b-a.t,b.b-b.t)"
PROX = f"({dcx('a','b')}<=1.25*a.cw AND {gy('a','b')}<=2.8*a.cw) OR ({gx('a','b')}<=2.2*a.cw AND (({oy('a','b')}>0 AND {oy('a','b')}>=0.15*{MINH}) OR {gy('a','b')}<=a.cw))"


@query("grp_proximity_cc", uses="boxes", also=width_sql("boxes", 16, 50, "least(r-l,b-t)") + ",\nsized AS (SELECT * FROM boxes JOIN units USING (page_id)),\n" + closure_sql("sized", "box_id", PROX), sql="SELECT page_id, box_id, cluster_id FROM comp")
def _(t):
    return GR.proximity_clusters(plain(t)).select("page_id", "box_id", "cluster_id")


def _side(x): return f"greatest({w(x)},{h(x)})"


@query("grp_reach_symmetric", uses="boxes", also=closure_sql("boxes", "box_id", f"{gx('a','b')}*10<=greatest({_side('a')},{_side('b')})*15 AND {gy('a','b')}*10<=greatest({_side('a')},{_side('b')})*15"), sql="SELECT page_id, box_id, cluster_id FROM comp")
def _(t):
    return GR.reach_clusters(plain(t), 150).select("page_id", "box_id", "cluster_id")


OUTSIDE = f"({gx('a','b')}<=1.85*a.cw AND {oy('a','b')}>0 AND {oy('a','b')}>=0.22*{MINH}) OR ({dcx('a','b')}<=0.75*a.cw AND {gy('a','b')}<=1.4*a.cw)"


@query("grp_outside_cc", uses="lines", also="src AS (SELECT * FROM lines WHERE category='ORPHAN'),\n" + width_sql("src", 10, 100000) + ",\nsized AS (SELECT * FROM src JOIN units USING (page_id)),\n" + closure_sql("sized", "line_id", OUTSIDE), sql="SELECT page_id, line_id, cluster_id FROM comp")
def _(t):
    return GR.outside_clusters(t.lines.where("category = 'ORPHAN'")).select("page_id", "line_id", "cluster_id")


AW, AH = "((a.r-a.l+b.r-b.l)/2.0)", "((a.b-a.t+b.b-b.t)/2.0)"
MW = "least(a.r-a.l,b.r-b.l)"
OX, OY = "(least(a.r,b.r)-greatest(a.l,b.l))", "(least(a.b,b.b)-greatest(a.t,b.t))"
FRAG_V = f"(({gx('a','b')}<1.5*{AW} AND {OY}>0.35*{MINH} AND abs((a.t+a.b-b.t-b.b)/2.0)<0.55*{MINH}) OR (({OX}>0.35*{MW} OR {gx('a','b')}<0.2*{AW}) AND {gy('a','b')}<0.55*{AH}))"
FRAG_H = f"(({gy('a','b')}<1.35*{AH} AND {OX}>0.4*{MW} AND abs((a.l+a.r-b.l-b.r)/2.0)<0.45*{MW}) OR (({OY}>0.4*{MINH} OR {gy('a','b')}<0.2*{AH}) AND {gx('a','b')}<0.5*{AW}))"
TALL = "((a.b-a.t)>1.15*(a.r-a.l) OR (b.b-b.t)>1.15*(b.r-b.l))"
OWNED = f"owned AS (SELECT x.*, coalesce((SELECT max(g.region_id) FROM regions g WHERE g.page_id=x.page_id AND ({holds('g','x')} OR {inter('x','g')}*100>=35*{area('x')})),-1) AS region_id FROM boxes x)"


def _fragments(name, rtl, fence):
    same = f"({FRAG_V} OR {cont_over('a','b',20)})" if rtl else f"(CASE WHEN {TALL} THEN {FRAG_V} ELSE {FRAG_H} END OR {cont_over('a','b',20)})"
    ok = "a.region_id=b.region_id" if fence else "(a.region_id=b.region_id OR a.region_id<0 OR b.region_id<0)"

    @query(name, uses="boxes regions", also=OWNED + ",\n" + closure_sql("owned", "box_id", f"{ok} AND {same}"), sql="SELECT page_id, box_id, cluster_id FROM comp")
    def _(t):
        return GR.fenced_fragments(plain(t), t.regions, rtl, fence).select("page_id", "box_id", "cluster_id")


_fragments("grp_fragments_fenced", True, False)
_fragments("grp_fragments_fenced_ltr", False, True)

CENTERED = f"owned AS (SELECT x.*, coalesce((SELECT min(g.region_id) FROM regions g WHERE g.page_id=x.page_id AND {holds('g','x')}),-1) AS region_id FROM boxes x)"
FREE = "(a.region_id=b.region_id OR a.region_id<0 OR b.region_id<0)"
BOUNDS = "SELECT page_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n FROM comp JOIN boxes USING (page_id, box_id) GROUP BY page_id, cluster_id"


@query("grp_lines_bridged", uses="boxes regions", also=CENTERED + ",\n" + closure_sql("owned", "box_id", f"{FREE} AND ({dcx('a','b')}<0.55*{MW} OR {OX}>0.3*{MW}) AND {gy('a','b')}<=2.5*{AH}"), sql=BOUNDS)
def _(t):
    return GR.cluster_bounds(GR.bridged_lines(plain(t), t.regions)).drop("cluster_id")


@query("grp_lines_bridged_ltr", uses="boxes regions", also=CENTERED + ",\n" + closure_sql("owned", "box_id", f"{FREE} AND ({dcy('a','b')}<0.55*{MINH} OR {OY}>0.3*{MINH}) AND {gx('a','b')}<=2.5*{AW}"), sql=BOUNDS)
def _(t):
    return GR.cluster_bounds(GR.bridged_lines(plain(t), t.regions, rtl=False)).drop("cluster_id")


@query("grp_lines_strict", uses="boxes", also=closure_sql("boxes", "box_id", f"{dcx('a','b')}<0.45*{MW} AND ({OX}>0.35*{MW} OR {dcx('a','b')}<0.3*{MW}) AND {gy('a','b')}<greatest(1.1*{AH},1.8*{AW})"), sql=BOUNDS)
def _(t):
    return GR.cluster_bounds(GR.strict_lines(plain(t))).drop("cluster_id")


HH = "greatest(least(a.b-a.t,b.b-b.t),1)"
BAR = "NOT EXISTS (SELECT 1 FROM zones z WHERE z.page_id=a.page_id AND ((z.l>least({0},{1}) AND z.l<greatest({0},{1})) OR (z.t>least({2},{3}) AND z.t<greatest({2},{3}))))".format(cx("a"), cx("b"), cy("a"), cy("b"))


@query("grp_outside_units", uses="boxes zones", also=closure_sql("boxes", "box_id", f"greatest(a.b-a.t,b.b-b.t)<=1.6*{HH} AND (({gx('a','b')}<0.85*{AW} AND {OY}>0.4*{HH}) OR ({gx('a','b')}<0.25*{AW} AND {gy('a','b')}<0.65*{AH})) AND {BAR}"), sql=f"""
SELECT * FROM (SELECT page_id, greatest(min(l)-6,0) AS l, greatest(min(t)-6,0) AS t, least(max(r)+6,512) AS r, least(max(b)+6,800) AS b, count(*) AS n FROM comp JOIN boxes USING (page_id, box_id) GROUP BY page_id, cluster_id) WHERE r-l>=10 AND b-t>=10""")
def _(t):
    gut = t.zones.select("page_id", F.col("l").alias("gutter_x"), F.col("t").alias("gutter_y"))
    return GR.outside_units(plain(t), gut, W, H).drop("cluster_id")


@query("grp_lobes", uses="lines regions", also=f"""owned AS (SELECT * FROM (SELECT x.*, (SELECT min(g.region_id) FROM regions g WHERE g.page_id=x.page_id AND {holds('g','x')}) AS region_id FROM lines x) WHERE region_id IS NOT NULL),
""" + closure_sql("owned", "line_id", f"{gx('a','b')}<=1.4*{AW} AND {OY}>0 AND {OY}>=0.35*{MINH} AND NOT ((abs(a.t-b.t)>0.7*{MINH} AND abs(a.b-b.b)>0.7*{MINH}) OR {OY}<0.3*{MINH})", ("page_id", "region_id")), sql="""
SELECT *, n>2 OR b-t>280 OR r-l>220 AS line_fallback FROM (SELECT page_id, region_id, greatest(min(l)-8,0) AS l, greatest(min(t)-8,0) AS t, least(max(r)+8,512) AS r, least(max(b)+8,800) AS b, count(*) AS n
FROM comp JOIN lines USING (page_id, line_id) GROUP BY page_id, region_id, cluster_id)""")
def _(t):
    return GR.lobes(t.lines, t.regions, W, H).drop("cluster_id")


SEEDS = "src AS (SELECT * FROM lines WHERE category='ORPHAN'),\n" + keep_first_sql("src", "line_id", "line_id", f"({dcx('a','b')}<140 AND {dcy('a','b')}<220)") + f""",
windows AS (SELECT a.page_id, a.line_id, a.b-a.t AS height, min(b.line_id) AS cluster_id FROM src a JOIN kept b ON a.page_id=b.page_id AND {dcx('a','b')}<140 AND {dcy('a','b')}<220 GROUP BY ALL)"""


@query("grp_seed_window", uses="lines", also=SEEDS, sql="SELECT page_id, line_id, cluster_id FROM windows")
def _(t):
    return GR.seed_windows(t.lines.where("category = 'ORPHAN'")).select("page_id", "line_id", "cluster_id")


@query("grp_seed_window_best", uses="lines", also=SEEDS, sql="""
SELECT page_id, cluster_id, CAST(sum(height) AS BIGINT) AS total_height, count(*) AS n_lines FROM windows GROUP BY page_id, cluster_id QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY sum(height) DESC, cluster_id)=1""")
def _(t):
    return GR.best_seed_window(t.lines.where("category = 'ORPHAN'"))


@query("grp_absorb_near", uses="boxes zones", also=f"""
u AS (SELECT page_id, list({{'id':zone_id,'l':l,'t':t,'r':r,'b':b,'n':0}} ORDER BY zone_id) AS us FROM zones GROUP BY page_id),
x AS (SELECT page_id, list({{'l':l,'t':t,'r':r,'b':b}} ORDER BY box_id) AS xs FROM boxes GROUP BY page_id),
walk AS (SELECT page_id, 0 AS i, us, coalesce(xs, []) AS xs FROM u LEFT JOIN x USING (page_id)
 UNION ALL SELECT page_id, i+1, list_transform(us, lambda k, j: CASE WHEN j=p THEN {{'id':k.id,'l':least(k.l,x.l),'t':least(k.t,x.t),'r':greatest(k.r,x.r),'b':greatest(k.b,x.b),'n':k.n+1}} ELSE k END), xs
 FROM (SELECT *, xs[i+1] AS x, list_position(list_transform(us, lambda k: {holds('k','xs[i+1]')} OR {cont_over('k','xs[i+1]',20)} OR ({gx('k','xs[i+1]')}<=6 AND {gy('k','xs[i+1]')}<=6)), true) AS p FROM walk WHERE i<len(xs)))""", sql="""
SELECT page_id, k.id AS unit_id, k.l AS l, k.t AS t, k.r AS r, k.b AS b, k.n AS n_absorbed FROM (SELECT page_id, unnest(us) AS k FROM walk WHERE i=len(xs))""")
def _(t):
    return GR.absorb_near(t.zones.select("page_id", F.col("zone_id").alias("unit_id"), *"ltrb"), plain(t))


IN_REGION = f"owned AS (SELECT * FROM (SELECT x.*, (SELECT min(g.region_id) FROM regions g WHERE g.page_id=x.page_id AND {holds('g','x')}) AS region_id FROM lines x) WHERE region_id IS NOT NULL)"


def owned_lines(t):
    return J.center_first(t.lines.select("page_id", "line_id", *"ltrb"), t.regions).where("region_id >= 0").withColumnRenamed("line_id", "box_id")


GROW = "{'id':k.id,'l':least(k.l,x.l),'t':least(k.t,x.t),'r':greatest(k.r,x.r),'b':greatest(k.b,x.b),'n':k.n+1}"


@query("grp_ruby_absorb", uses="lines regions", also=IN_REGION + f""",
s AS (SELECT *, CAST(24 AS INT) AS cw, (r-l)*100<24*52 AND b-t>6 AS narrow FROM owned),
g AS (SELECT page_id, region_id, coalesce(list({{'id':line_id,'l':l,'t':t,'r':r,'b':b,'n':0}} ORDER BY line_id) FILTER (WHERE NOT narrow),[]) AS main, coalesce(list({{'id':line_id,'l':l,'t':t,'r':r,'b':b,'n':0}} ORDER BY line_id) FILTER (WHERE narrow),[]) AS ruby FROM s GROUP BY ALL),
walk AS (SELECT page_id, region_id, 0 AS i, main AS acc, main, ruby FROM g WHERE len(main)>0
 UNION ALL SELECT page_id, region_id, i+1, CASE WHEN aligned OR p IS NULL THEN list_append(acc, x) ELSE list_transform(acc, lambda k, j: CASE WHEN j=p.j THEN {GROW} ELSE k END) END, main, ruby
 FROM (SELECT *, ruby[i+1] AS x, len(list_filter(main, lambda m: {dcx('m','ruby[i+1]')}*100<=24*38))>0 AS aligned,
  list_sort(list_filter(list_transform(acc, lambda k, j: CASE WHEN {oy('k','ruby[i+1]')}>0 AND {dcx('k','ruby[i+1]')}*100>=24*38 AND {dcx('k','ruby[i+1]')}*100<=24*140 THEN {{'d':{dcx('k','ruby[i+1]')},'j':j}} END), lambda q: q IS NOT NULL))[1] AS p FROM walk WHERE i<len(ruby))),
done AS (SELECT page_id, region_id, unnest(acc) AS k FROM walk WHERE i=len(ruby) UNION ALL SELECT page_id, region_id, unnest(ruby) FROM g WHERE len(main)=0)""", sql="""
SELECT page_id, region_id, k.id AS box_id, k.l AS l, k.t AS t, k.r AS r, k.b AS b, k.n AS absorbed FROM done""")
def _(t):
    return GR.ruby_absorb(owned_lines(t).withColumn("cw", F.lit(24))).drop("cw")


def ruby_gap_sql(src):
    return f"""
ru AS (SELECT page_id, region_id, CAST(least(greatest(list_sort(list(r-l))[count(*)//2+1],14),40) AS INT) AS cw, count(*) AS n_all FROM {src} GROUP BY ALL),
rs AS (SELECT {src}.*, n_all, (r-l)*100<cw*48 AS narrow FROM {src} JOIN ru USING (page_id, region_id)),
rg AS (SELECT page_id, region_id, any_value(n_all) AS n_all, coalesce(list({{'id':box_id,'l':l,'t':t,'r':r,'b':b}} ORDER BY box_id) FILTER (WHERE NOT narrow OR n_all<2),[]) AS main, coalesce(list({{'id':box_id,'l':l,'t':t,'r':r,'b':b}} ORDER BY box_id) FILTER (WHERE narrow AND n_all>1),[]) AS ruby FROM rs GROUP BY ALL),
rwalk AS (SELECT page_id, region_id, 0 AS i, main AS acc, ruby FROM rg
 UNION ALL SELECT page_id, region_id, i+1, list_transform(acc, lambda k, j: CASE WHEN j=p THEN {{'id':k.id,'l':least(k.l,x.l),'t':least(k.t,x.t),'r':greatest(k.r,x.r),'b':greatest(k.b,x.b)}} ELSE k END), ruby
 FROM (SELECT *, ruby[i+1] AS x, list_position(list_transform(acc, lambda k: {oy('k','ruby[i+1]')}>0 AND {gx('k','ruby[i+1]')}<=12), true) AS p FROM rwalk WHERE i<len(ruby))),
ruby_done AS (SELECT page_id, region_id, k.id AS box_id, k.l AS l, k.t AS t, k.r AS r, k.b AS b, ruby_count FROM (SELECT page_id, region_id, unnest(acc) AS k, len(ruby) AS ruby_count FROM rwalk WHERE i=len(ruby)))"""


@query("grp_ruby_absorb_gap", uses="lines regions", also=IN_REGION + ",\nob AS (SELECT page_id, region_id, line_id AS box_id, l,t,r,b FROM owned)," + ruby_gap_sql("ob"), sql="SELECT * FROM ruby_done")
def _(t):
    return GR.ruby_absorb_gap(owned_lines(t), hot=None if hot_pages(t.lines) is None else "find")  # a region holds no more lines than its page


def smear_sql(src, out="pieces", keys="page_id, region_id"):
    return f"""
su AS (SELECT {keys}, CAST(least(greatest(list_sort(list(r-l))[count(*)//2+1],16),34) AS INT) AS cw FROM {src} GROUP BY {keys}),
sn AS (SELECT {src}.*, cw, CASE WHEN (r-l)>=1.85*cw AND floor((r-l)/cw+0.5)>=2 THEN CAST(floor((r-l)/cw+0.5) AS INT) ELSE 1 END AS nn FROM {src} JOIN su USING ({keys})),
{out} AS (SELECT * EXCLUDE (l, r, nn), l+piece*(r-l)//nn AS l, CASE WHEN piece=nn-1 THEN r ELSE l+(piece+1)*(r-l)//nn END AS r FROM (SELECT *, CAST(unnest(range(nn)) AS INT) AS piece FROM sn))"""


@query("grp_split_smear", uses="lines regions", also=IN_REGION + ",\nob AS (SELECT page_id, region_id, line_id AS box_id, l,t,r,b FROM owned)," + smear_sql("ob"), sql="SELECT page_id, region_id, box_id, piece, l, t, r, b FROM pieces")
def _(t):
    return GR.split_smear(owned_lines(t)).select("page_id", "region_id", "box_id", "piece", *"ltrb")


def chain_sql(src, keys="page_id, region_id"):
    """Every box alone in (strip, top) order; a new chain starts beyond the running bottom."""
    return f"""
cs AS (SELECT *, greatest(gr-gl,1) AS fw, CAST(greatest(1,floor(greatest(gr-gl,1)/cw+0.5)) AS INT) AS nc FROM {src}),
cp AS (SELECT *, least(CAST(floor(least(greatest((l+r)//2-gl,0),fw-1)*nc/fw) AS INT),nc-1) AS strip FROM cs),
cn AS (SELECT *, CASE WHEN t-max(b) OVER wb>4.5*cw OR max(b) OVER wb IS NULL THEN 1 ELSE 0 END AS fresh FROM cp WINDOW wb AS (PARTITION BY {keys}, strip ORDER BY t, box_id, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cc AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys}, strip ORDER BY t, box_id, piece ROWS UNBOUNDED PRECEDING) AS chain FROM cn),
chains AS (SELECT {keys}, strip, chain, greatest(0,least(min(l),512)) AS l, greatest(0,least(min(t),800)) AS t, greatest(0,least(max(r),512)) AS r, greatest(0,least(max(b),800)) AS b, count(*) AS n_boxes FROM cc GROUP BY ALL)"""


@query("grp_strip_chain", uses="lines regions", also=IN_REGION + """,
ob AS (SELECT o.page_id, o.region_id, line_id AS box_id, 0 AS piece, o.l,o.t,o.r,o.b, 20 AS cw, g.l AS gl, g.r AS gr FROM owned o JOIN regions g ON g.page_id=o.page_id AND g.region_id=o.region_id),""" + chain_sql("ob"), sql="SELECT page_id, region_id, l, t, r, b, n_boxes FROM chains")
def _(t):
    d = owned_lines(t).join(t.regions.select("page_id", "region_id", *[F.col(s).alias("g" + s) for s in "ltrb"]), ["page_id", "region_id"])
    return GR.strip_chain(d.withColumn("cw", F.lit(20)), W, H).drop("strip", "chain")


@query("grp_seam_trim", uses="lines regions", also=IN_REGION + f""",
o AS (SELECT page_id, region_id, list({{'id':line_id,'l':l,'t':t,'r':r,'b':b}} ORDER BY {cx('owned')}, line_id) AS xs FROM owned GROUP BY ALL),
walk AS (SELECT page_id, region_id, 1 AS i, xs FROM o UNION ALL SELECT page_id, region_id, i+1, CASE WHEN xs[i].r>xs[i+1].l THEN list_transform(xs, lambda k, j: CASE WHEN j=i THEN {{'id':k.id,'l':k.l,'t':k.t,'r':(xs[i].r+xs[i+1].l)//2,'b':k.b}}
 WHEN j=i+1 THEN {{'id':k.id,'l':(xs[i].r+xs[i+1].l)//2,'t':k.t,'r':k.r,'b':k.b}} ELSE k END) ELSE xs END FROM walk WHERE i<len(xs))""", sql="""
SELECT page_id, region_id, k.id AS box_id, k.l AS l, k.t AS t, k.r AS r, k.b AS b FROM (SELECT page_id, region_id, unnest(xs) AS k FROM walk WHERE i=len(xs))""")
def _(t):
    return GR.seam_trim(owned_lines(t), "box_id").select("page_id", "region_id", "box_id", *"ltrb")


@query("grp_region_exclusion", uses="lines regions", also=f"""
ins AS (SELECT x.*, arg_min(g, [CASE WHEN {holds('g','x')} THEN 0 ELSE 1 END, CASE WHEN {holds('g','x')} THEN 0 ELSE {dcx('g','x')}+{dcy('g','x')} END, g.region_id]) AS g FROM (SELECT * FROM lines WHERE category='BUBBLED') x LEFT JOIN regions g ON g.page_id=x.page_id GROUP BY ALL),
clamped AS (SELECT page_id, line_id, category, CAST(greatest(l,g.l) AS INT) AS l, CAST(greatest(t,g.t) AS INT) AS t, CAST(least(r,g.r) AS INT) AS r, CAST(least(b,g.b) AS INT) AS b FROM ins),
outl AS (SELECT x.page_id, x.line_id, x.category, {{'l':x.l,'t':x.t,'r':x.r,'b':x.b,'ok':true}} AS a, coalesce(list(g ORDER BY g.region_id) FILTER (WHERE {inter('x','g')}>0),[]) AS gs FROM lines x LEFT JOIN regions g ON g.page_id=x.page_id WHERE category<>'BUBBLED' GROUP BY ALL),
walk AS (SELECT page_id, line_id, category, a, gs, 0 AS i FROM outl UNION ALL
 SELECT page_id, line_id, category, CASE WHEN NOT a.ok OR {inter('a','g')}=0 THEN a WHEN {area('a')}>0 AND ({inter('a','g')}*100>=35*{area('a')} OR a.b-a.t<24) THEN {{'l':a.l,'t':a.t,'r':a.r,'b':a.b,'ok':false}} ELSE {{'l':c.l,'t':c.t,'r':c.r,'b':c.b,'ok':c.r-c.l>=8 AND c.b-c.t>=12}} END, gs, i+1
 FROM (SELECT *, CASE WHEN a.t<g.t AND a.b>g.t THEN {{'l':a.l,'t':a.t,'r':a.r,'b':g.t}} WHEN a.b>g.b AND a.t<g.b THEN {{'l':a.l,'t':g.b,'r':a.r,'b':a.b}} WHEN a.l<g.l AND a.r>g.l THEN {{'l':a.l,'t':a.t,'r':g.l,'b':a.b}} WHEN a.r>g.r AND a.l<g.r THEN {{'l':g.r,'t':a.t,'r':a.r,'b':a.b}} ELSE {{'l':a.l,'t':a.t,'r':a.r,'b':a.b}} END AS c
  FROM (SELECT *, gs[i+1] AS g FROM walk WHERE i<len(gs)))),
res AS (SELECT * FROM clamped UNION ALL SELECT page_id, line_id, category, a.l, a.t, a.r, a.b FROM walk WHERE i=len(gs) AND a.ok)""", sql="SELECT * FROM res WHERE r-l>=8 AND b-t>=12")
def _(t):
    return GR.region_exclusion(t.lines, t.regions)


@query("split_tall_regions", uses="lines regions", also=f"""
held AS (SELECT g.page_id, g.region_id, x.line_id, {cy('x')} AS cy, x.t, x.b FROM regions g JOIN lines x ON x.page_id=g.page_id AND {holds('g','x')} WHERE (g.b-g.t)>1.35*(g.r-g.l)),
nxt AS (SELECT *, lag(t) OVER w AS pt, lag(b) OVER w AS pb FROM held WINDOW w AS (PARTITION BY page_id, region_id ORDER BY cy, line_id)),
cut AS (SELECT page_id, region_id, (pb+t)//2 AS y FROM nxt WHERE t-pb>0 AND t-pb>0.4*((b-t)+(pb-pt))/2 QUALIFY row_number() OVER (PARTITION BY page_id, region_id ORDER BY t-pb DESC, cy, line_id)=1),
j AS (SELECT g.*, CASE WHEN y>=t+20 AND y<b-20 THEN y END AS y FROM regions g LEFT JOIN cut USING (page_id, region_id))""", sql="""
SELECT page_id, region_id, 0 AS part, l, t, r, b FROM j WHERE y IS NULL UNION ALL SELECT page_id, region_id, 1, l, t, r, CAST(y AS INT) FROM j WHERE y IS NOT NULL UNION ALL SELECT page_id, region_id, 2, l, CAST(y AS INT), r, b FROM j WHERE y IS NOT NULL""")
def _(t):
    return GR.split_tall_regions(t.regions, t.lines)


# ---- order-dependent unions -------------------------------------------------------------------

def fixpoint_sql(src, row_id, cond, limit):
    """One union per step: the first qualifying pair in list order, then start over."""
    return f"""
o AS (SELECT page_id, list({{'id':{row_id},'l':l,'t':t,'r':r,'b':b}} ORDER BY {row_id}) AS xs FROM {src} GROUP BY page_id),
walk AS (SELECT page_id, 0 AS i, xs, true AS more FROM o UNION ALL
 SELECT page_id, i+1, CASE WHEN p IS NULL THEN xs ELSE list_transform(list_filter(xs, lambda k, j: j<>p[2]), lambda k, j: CASE WHEN j=p[1] THEN {{'id':k.id,'l':least(k.l,xs[p[2]].l),'t':least(k.t,xs[p[2]].t),'r':greatest(k.r,xs[p[2]].r),'b':greatest(k.b,xs[p[2]].b)}} ELSE k END) END, p IS NOT NULL
 FROM (SELECT *, list_filter(flatten(list_transform(range(1,len(xs)+1), lambda m: list_transform(range(m+1,len(xs)+1), lambda n: CASE WHEN {inter('xs[m]','xs[n]')}>0 AND ({cond('xs[m]','xs[n]')}) THEN [m,n] END))), lambda q: q IS NOT NULL)[1] AS p FROM walk WHERE more AND i<{limit})),
done AS (SELECT page_id, unnest(arg_max(xs, i)) AS k FROM walk GROUP BY page_id)"""


FIX_OUT = "SELECT page_id, k.id AS {0}, k.l AS l, k.t AS t, k.r AS r, k.b AS b FROM done"


@query("grp_fixpoint_union", uses="boxes", also=fixpoint_sql("boxes", "box_id", lambda p, q: f"{inter(p, q)}*100>=40*{min_area(p, q)}", 1000000), sql=FIX_OUT.format("box_id"))
def _(t):
    return GR.merge_overlaps(plain(t), "nested")


@query("grp_fixpoint_union_alike", uses="regions", also=fixpoint_sql("regions", "region_id", lambda p, q: f"{iou_over(p, q, 45)} OR {cont_over(p, q, 85)}", 1000000), sql=FIX_OUT.format("region_id"))
def _(t):
    return GR.merge_overlaps(t.regions, "alike", row_id="region_id")


@query("grp_fixpoint_union_touching", uses="regions", also=fixpoint_sql("regions", "region_id", lambda p, q: cont_over(p, q, 12), 1000000), sql=FIX_OUT.format("region_id"))
def _(t):
    return GR.merge_overlaps(t.regions, "touching", row_id="region_id")
