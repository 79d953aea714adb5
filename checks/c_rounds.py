"""Round-based grouping. The SQL walks the same rounds over all pairs of a page, without tiles and without leaving pages out early."""

from pyspark.sql import functions as F

from checks.c_joins import assign_sql, plain
from checks.c_projections import H, W
from checks.registry import query
from checks.sqlgeo import *
from pagelattice.functions import geometry as G
from pagelattice.operators import audits as A, grouping as GR, joins as J, rounds as R

ENCLOSING = "min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b"
MINH = f"least({h('a')},{h('b')})"


def uw(a, b): return f"(greatest({a}.r,{b}.r)-least({a}.l,{b}.l))"
def uh(a, b): return f"(greatest({a}.b,{b}.b)-least({a}.t,{b}.t))"


def rounds_sql(src, row_id, cols, link, rank, grown, keys="page_id", out="fin", more="", settle=None):
    """Best link of each row, links that are the best of both ends, rows united; the last step of each page is its result."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k}=b.{k}" for k in ks)
    of = lambda x: ", ".join(f"{x}.{k}" for k in ks)
    ranks = "".join(f"'k{i}': {x}, " for i, x in enumerate(rank))
    settle = settle or f"""SELECT step+1 AS step, {of('w')}, coalesce(c.e.u, w.{row_id}) AS {row_id}, {grown} FROM w LEFT JOIN c ON {' AND '.join(f'c.{k}=w.{k}' for k in ks)} AND c.e.v=w.{row_id}
  WHERE ({of('w')}) IN (SELECT ({keys}) FROM e) GROUP BY step, {of('w')}, coalesce(c.e.u, w.{row_id})"""
    return f"""w AS (SELECT 0 AS step, {keys}, {row_id}, {cols} FROM {src} UNION ALL
 (WITH e AS (SELECT {of('a')}, {{{ranks}'u': a.{row_id}, 'v': b.{row_id}{more}}} AS e FROM w a JOIN w b ON {same} AND a.{row_id}<b.{row_id} AND {link}),
  n AS (SELECT {keys}, e.u AS id, e FROM e UNION ALL SELECT {keys}, e.v, e FROM e),
  m AS (SELECT {keys}, id, min(e) AS e FROM n GROUP BY ALL),
  c AS (SELECT {keys}, e FROM m GROUP BY ALL HAVING count(*)=2)
  {settle})),
{out} AS (SELECT * FROM w WHERE ({keys}, step) IN (SELECT ({keys}, max(step)) FROM w GROUP BY {keys}))"""


RANK = f"{{'level': CASE w.category WHEN 'BUBBLED' THEN -3 WHEN 'ORPHAN' THEN -2 ELSE -1 END, 'area': -{area('w')}, 'id': w.line_id}}"


@query("grp_line_dedup", uses="lines", also=f"""
w AS (SELECT 0 AS step, page_id, line_id, category, l, t, r, b FROM lines UNION ALL
 (WITH k AS (SELECT *, {RANK} AS rk FROM w),
  p AS (SELECT a.page_id, a.line_id AS hi, b.line_id AS lo, a.rk FROM k a JOIN k b ON a.page_id=b.page_id AND a.rk<b.rk AND {cont_over('a', 'b', 65)}),
  s AS (SELECT page_id, lo AS id, min(rk) AS by FROM p GROUP BY ALL),
  m AS (SELECT s.page_id, s.id, s.by.id AS to_id FROM s ANTI JOIN s z ON z.page_id=s.page_id AND z.id=s.by.id)
  SELECT step+1, k.page_id, coalesce(to_id, line_id) AS line_id, arg_min(category, rk) AS category, {ENCLOSING} FROM k LEFT JOIN m ON m.page_id=k.page_id AND m.id=k.line_id
  WHERE k.page_id IN (SELECT page_id FROM p) GROUP BY step, k.page_id, coalesce(to_id, line_id))),
fin AS (SELECT * FROM w WHERE (page_id, step) IN (SELECT (page_id, max(step)) FROM w GROUP BY page_id))""",
       sql="SELECT page_id, line_id, category, l, t, r, b FROM fin")
def _(t):
    return R.line_dedup(t.lines)


def wide_lines(t):
    return GR.with_char_width(t.lines, 18, 48, 26)


WIDE = "units AS (SELECT page_id, CAST(least(greatest(list_sort(list(greatest(r-l,0)))[count(*)//2+1],18),48) AS INT) AS cw FROM lines GROUP BY page_id),\nsized AS (SELECT lines.*, cw FROM lines JOIN units USING (page_id))"


@query("grp_unbubbled_extend", uses="lines", also=WIDE + ",\nsrc AS (SELECT * FROM sized WHERE category<>'BUBBLED'),\n" + rounds_sql(
    "src", "line_id", "category, l, t, r, b, cw",
    f"{dcx('a', 'b')}*100<=a.cw*35 AND {uw('a', 'b')}*100<=a.cw*140 AND {gy('a', 'b')}<=a.cw*3 AND {oy('a', 'b')}*100<={MINH}*30",
    [gy("a", "b"), dcx("a", "b")], f"max(category) AS category, {ENCLOSING}, min(cw) AS cw"),
    sql="SELECT page_id, line_id, category, l, t, r, b FROM fin UNION ALL SELECT page_id, line_id, category, l, t, r, b FROM lines WHERE category='BUBBLED'")
def _(t):
    return R.unbubbled_extend(wide_lines(t))


def reach_sql(percent):
    reach = f"floor(greatest({w('a')},{h('a')})*{percent}/100)"
    return f"""links AS (SELECT a.page_id, a.box_id AS u, b.box_id AS v FROM boxes a JOIN boxes b ON a.page_id=b.page_id AND a.box_id<>b.box_id AND {gx('a', 'b')}<={reach} AND {gy('a', 'b')}<={reach}),
ways AS (SELECT page_id, box_id AS u, box_id AS v FROM boxes UNION SELECT s.page_id, s.u, l.v FROM ways s JOIN links l ON l.page_id=s.page_id AND l.u=s.v)"""


def _reach(name, percent):
    @query(name, uses="boxes", also=reach_sql(percent), sql="SELECT page_id, v AS box_id, min(u) AS cluster_id FROM ways GROUP BY page_id, v")
    def _(t):
        return R.reach_seeded(plain(t), percent).select("page_id", "box_id", "cluster_id")


_reach("grp_reach_seeded", 250)
_reach("grp_reach_seeded_150", 150)

def trim_sql(src, row_id, more=""):
    return f"""q AS (SELECT a.page_id, a.{row_id} AS u, b.{row_id} AS v, abs({cy('b')}-{cy('a')})>=abs({cx('b')}-{cx('a')}) AS stacked, {cy('b')}>={cy('a')} AS below, {cx('b')}>={cx('a')} AS right_of,
 (greatest(a.t,b.t)+least(a.b,b.b))//2 AS y, (greatest(a.l,b.l)+least(a.r,b.r))//2 AS x FROM {src} a JOIN {src} b ON a.page_id=b.page_id AND a.{row_id}<b.{row_id} AND {inter('a', 'b')}>0),
c AS (SELECT page_id, u AS {row_id}, CASE WHEN stacked AND below THEN y END AS cb, CASE WHEN stacked AND NOT below THEN y END AS ct, CASE WHEN NOT stacked AND right_of THEN x END AS cr, CASE WHEN NOT stacked AND NOT right_of THEN x END AS cl FROM q
 UNION ALL SELECT page_id, v, CASE WHEN stacked AND NOT below THEN y END, CASE WHEN stacked AND below THEN y END, CASE WHEN NOT stacked AND NOT right_of THEN x END, CASE WHEN NOT stacked AND right_of THEN x END FROM q),
s AS (SELECT page_id, {row_id}, min(cb) AS cb, max(ct) AS ct, min(cr) AS cr, max(cl) AS cl FROM c GROUP BY ALL),
z AS (SELECT page_id, {row_id}{more}, greatest(0,least(512,greatest(l,cl))) AS l, greatest(0,least(800,greatest(t,ct))) AS t, greatest(0,least(512,least(r,cr))) AS r, greatest(0,least(800,least(b,cb))) AS b FROM {src} LEFT JOIN s USING (page_id, {row_id}))"""


TRIM = f"""o AS (SELECT page_id, list({{'id':box_id,'l':l,'t':t,'r':r,'b':b}} ORDER BY box_id) AS xs FROM boxes GROUP BY page_id),
walk AS (SELECT page_id, 0 AS i, xs, true AS more FROM o UNION ALL
 SELECT page_id, i+1, CASE WHEN p IS NULL THEN xs ELSE list_transform(list_filter(xs, lambda k, j: j<>p[2]), lambda k, j: CASE WHEN j=p[1] THEN {{'id':k.id,'l':least(k.l,xs[p[2]].l),'t':least(k.t,xs[p[2]].t),'r':greatest(k.r,xs[p[2]].r),'b':greatest(k.b,xs[p[2]].b)}} ELSE k END) END, p IS NOT NULL
 FROM (SELECT *, list_filter(flatten(list_transform(range(1,len(xs)+1), lambda m: list_transform(range(m+1,len(xs)+1), lambda n: CASE WHEN {cont_over('xs[m]', 'xs[n]', 12)} AND {inter('xs[m]', 'xs[n]')}>0 THEN [m,n] END))), lambda q: q IS NOT NULL)[1] AS p FROM walk WHERE more)),
u AS (SELECT page_id, k.id AS box_id, k.l AS l, k.t AS t, k.r AS r, k.b AS b FROM (SELECT page_id, unnest(arg_max(xs, i)) AS k FROM walk GROUP BY page_id)),
""" + trim_sql("u", "box_id")


@query("grp_edge_trim", uses="boxes", also=TRIM, sql="SELECT page_id, box_id, CAST(l AS INT) AS l, CAST(t AS INT) AS t, CAST(r AS INT) AS r, CAST(b AS INT) AS b FROM z WHERE r-l>=10 AND b-t>=10")
def _(t):
    return R.edge_trim(GR.merge_overlaps(plain(t), "touching"), W, H)


COLUMN = f"({dcx('a', 'b')}*100<a.cw*85 OR {uw('a', 'b')}<=floor(a.cw*165/100) OR (least({w('a')},{w('b')})>0 AND {ox('a', 'b')}*100>=least({w('a')},{w('b')})*25 AND {uw('a', 'b')}<=floor(a.cw*210/100)))"


def cross_side(x, y, left):
    """New left and right side of x against y; ``left``: whether x is the left one."""
    trimmed, free = f"({y}.category='BUBBLED' AND {x}.category<>'BUBBLED')", f"(({x}.category='BUBBLED')=({y}.category='BUBBLED') AND NOT {COLUMN})"
    mid = f"CASE WHEN {cx('a')}<{cx('b')} THEN (a.r+b.l)//2 ELSE (b.r+a.l)//2 END"
    lo = f"CASE WHEN {trimmed} AND NOT {left} THEN greatest({x}.l,{y}.r) WHEN {free} AND NOT {left} THEN {mid} ELSE {x}.l END"
    hi = f"CASE WHEN {trimmed} AND {left} THEN least({x}.r,{y}.l) WHEN {free} AND {left} THEN {mid} ELSE {x}.r END"
    gone = f"(({trimmed} AND {area(x)}>0 AND {inter(x, y)}*100>={area(x)}*40) OR (({trimmed} OR {free}) AND ({hi})-({lo})<6))"
    return f"{{'l': {lo}, 'r': {hi}, 'gone': {gone}}}"


A_LEFT = f"({cx('a')}<{cx('b')})"
CROSS_MORE = f", 'one': (a.category='BUBBLED')=(b.category='BUBBLED') AND {COLUMN}, 'x': {cross_side('a', 'b', A_LEFT)}, 'y': {cross_side('b', 'a', f'(NOT {A_LEFT})')}"
CROSS_SETTLE = f""", q AS (SELECT page_id, e.u AS id, e.u AS to_id, e.x AS s FROM c UNION ALL SELECT page_id, e.v, CASE WHEN e.one THEN e.u ELSE e.v END, e.y FROM c)
  SELECT step+1 AS step, w.page_id, coalesce(to_id, line_id) AS line_id, max(category) AS category, CAST(min(coalesce(s.l, l)) AS INT) AS l, min(t) AS t, CAST(max(coalesce(s.r, r)) AS INT) AS r, max(b) AS b, min(cw) AS cw
  FROM w LEFT JOIN q ON q.page_id=w.page_id AND q.id=w.line_id WHERE w.page_id IN (SELECT page_id FROM e) AND NOT coalesce(s.gone, false) GROUP BY step, w.page_id, coalesce(to_id, line_id)"""


@query("grp_crossover_resolve", uses="lines", also=WIDE + ",\n" + rounds_sql(
    "sized", "line_id", "category, l, t, r, b, cw", f"{inter('a', 'b')}>0", [f"-{inter('a', 'b')}"], "", more=CROSS_MORE, settle=CROSS_SETTLE),
    sql="SELECT page_id, line_id, category, l, t, r, b FROM fin")
def _(t):
    return R.crossover_resolve(wide_lines(t))


GLYPH_W = """unit AS (SELECT page_id, CAST(least(greatest(coalesce(list_sort(list(r-l) FILTER (WHERE b-t>=r-l))[count(*) FILTER (WHERE b-t>=r-l)//2+1], list_sort(list(r-l))[count(*)//2+1]),16),44) AS INT) AS cw FROM placed GROUP BY page_id),
runit AS (SELECT page_id, region_id, CAST(least(greatest(coalesce(list_sort(list(r-l) FILTER (WHERE b-t>=r-l))[count(*) FILTER (WHERE b-t>=r-l)//2+1], list_sort(list(r-l))[count(*)//2+1]),16),44) AS INT) AS cwr FROM placed WHERE region_id IS NOT NULL GROUP BY ALL),
glyphs AS (SELECT p.*, cw, cwr FROM placed p JOIN unit USING (page_id) LEFT JOIN runit USING (page_id, region_id))"""
GW = "coalesce(a.cwr,b.cwr,a.cw)"
NEAR4 = "({0}.l-4<={1}.l AND {0}.t-4<={1}.t AND {0}.r+4>={1}.r AND {0}.b+4>={1}.b)"
GLYPH = f"""(a.region_id IS NULL OR b.region_id IS NULL OR a.region_id=b.region_id) AND (({min_area('a', 'b')}>0 AND {inter('a', 'b')}*100>=35*{min_area('a', 'b')}) OR {NEAR4.format('a', 'b')} OR {NEAR4.format('b', 'a')}
 OR ({oy('a', 'b')}*100>=greatest(1,{MINH})*40 AND {gx('a', 'b')}<=greatest(6,floor({GW}*22/100)) AND (greatest({w('a')},{w('b')})*100<={GW}*85 OR (least({w('a')},{w('b')})*100<={GW}*60 AND greatest({w('a')},{w('b')})*100<={GW}*115)) AND {uw('a', 'b')}*100<={GW}*125 AND {uh('a', 'b')}<=greatest({h('a')},{h('b')})+floor({GW}*30/100))
 OR (({ox('a', 'b')}*100>=greatest(1,least({w('a')},{w('b')}))*40 OR {dcx('a', 'b')}*100<={GW}*35) AND {gy('a', 'b')}<=greatest(6,floor({GW}*25/100)) AND {uh('a', 'b')}*100<={GW}*128 AND {uw('a', 'b')}*100<={GW}*125))"""


def glyph_boxes(t):
    """Boxes with the first region that holds their centre, and width units of page and region."""
    placed = J.center_first(plain(t), t.regions).withColumn("region_id", F.when(F.col("region_id") >= 0, F.col("region_id")))
    return GR.with_glyph_widths(placed)


@query("grp_recombine_glyphs", uses="boxes regions", also=f"placed AS (SELECT x.*, (SELECT min(g.region_id) FROM regions g WHERE g.page_id=x.page_id AND {holds('g', 'x')}) AS region_id FROM boxes x),\n" + GLYPH_W + ",\n" + rounds_sql(
    "glyphs", "box_id", "region_id, l, t, r, b, cw, cwr", GLYPH, [f"{gx('a', 'b')}+{gy('a', 'b')}", f"{uw('a', 'b')}*{uh('a', 'b')}"],
    f"min(region_id) AS region_id, {ENCLOSING}, min(cw) AS cw, min(cwr) AS cwr"),
    sql="SELECT page_id, box_id, region_id, l, t, r, b FROM fin")
def _(t):
    return R.recombine_glyphs(glyph_boxes(t)).select("page_id", "box_id", "region_id", *"ltrb")


OUT_COLS = f"""cw0 AS (SELECT page_id, CAST(least(greatest(coalesce(list_sort(list(r-l) FILTER (WHERE b-t>=16 AND r-l>=12))[count(*) FILTER (WHERE b-t>=16 AND r-l>=12)//2+1],26),18),48) AS INT) AS cw FROM boxes GROUP BY page_id),
src AS (SELECT b.page_id, b.conf_m%3>0 AS orphan, b.box_id, b.l, b.t, b.r, b.b, cw, CAST(1 AS BIGINT) AS n, CAST((b.l+b.r)//2 AS BIGINT) AS s FROM boxes b JOIN cw0 USING (page_id))"""


def sized_boxes(t):
    a = G.rect()
    return GR.with_char_width(t.boxes, 18, 48, 26, only=(G.height(a) >= 16) & (G.width(a) >= 12))


@query("grp_columns_outside", uses="boxes", also=OUT_COLS + ",\n" + rounds_sql(
    "src", "box_id", "l, t, r, b, cw, n, s", f"abs(a.s*b.n-b.s*a.n)*100<=a.cw*a.n*b.n*60 AND {gy('a', 'b')}<=a.cw*2 AND {oy('a', 'b')}*100<={MINH}*25", ["abs(a.s/a.n-b.s/b.n)", gy("a", "b")],
    f"{ENCLOSING}, min(cw) AS cw, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s", keys="page_id, orphan") + """,
wide AS (SELECT *, least(s//n-half,l) AS wl, greatest(s//n+half,r) AS wr FROM (SELECT *, CAST(floor(least(greatest(floor(cw*115/100),18),52)/2) AS INT) AS half FROM fin)),
judged AS (SELECT *, orphan AND (wr-wl)*100<=cw*145 AND (b-t)*100>=cw*180 AND n>=2 AND (b-t)*100>=(wr-wl)*130 AS ok FROM wide),
res AS (SELECT page_id, box_id AS column_id, CASE WHEN ok THEN 'ORPHAN' ELSE 'SFX' END AS category, CAST(CASE WHEN ok THEN wl ELSE l END AS INT) AS l, t, CAST(CASE WHEN ok THEN wr ELSE r END AS INT) AS r, b, n AS n_boxes FROM judged)""",
    sql="SELECT * FROM res WHERE r-l>=6 AND b-t>=6")
def _(t):
    return R.columns_outside(sized_boxes(t).withColumn("orphan", F.col("conf_m") % 3 > 0))


COLS = f"""cw0 AS (SELECT page_id, CAST(least(greatest(coalesce(list_sort(list(r-l) FILTER (WHERE b-t>=16 AND r-l>=12))[count(*) FILTER (WHERE b-t>=16 AND r-l>=12)//2+1],26),18),48) AS INT) AS cw FROM boxes GROUP BY page_id),
{assign_sql("boxes")},
cut AS (SELECT * FROM (SELECT a.page_id, a.region_id, a.box_id, greatest(a.l,g.l) AS l, greatest(a.t,g.t) AS t, least(a.r,g.r) AS r, least(a.b,g.b) AS b, cw, g.l AS gl, g.t AS gt, g.r AS gr, g.b AS gb
 FROM assigned a JOIN regions g ON g.page_id=a.page_id AND g.region_id=a.region_id JOIN cw0 ON cw0.page_id=a.page_id) WHERE r-l>=6 AND b-t>=6)"""
RUBY = f"""fu AS (SELECT page_id, region_id, list_sort(list(r-l) FILTER (WHERE b-t>=16 AND r-l>=12))[count(*) FILTER (WHERE b-t>=16 AND r-l>=12)//2+1] AS m FROM fin GROUP BY ALL),
un AS (SELECT page_id, region_id, gl, gt, gr, gb, cw, CAST(greatest(1, floor(((gr-gl)*100-cw*30)/(cw*120))) AS INT) AS most FROM
 (SELECT page_id, region_id, min(gl) AS gl, min(gt) AS gt, min(gr) AS gr, min(gb) AS gb, CAST(least(greatest(coalesce(any_value(m), min(cw)),16),greatest(48,min(cw)*3//2)) AS INT) AS cw FROM cut JOIN fu USING (page_id, region_id) GROUP BY page_id, region_id)),
bx AS (SELECT f.*, un.cw, (f.r-f.l)*100<un.cw*52 AND f.b-f.t>6 AS small FROM fin f JOIN un USING (page_id, region_id)),
lone AS (SELECT * FROM bx a WHERE small AND NOT EXISTS (SELECT 1 FROM bx b WHERE b.page_id=a.page_id AND b.region_id=a.region_id AND NOT b.small AND {dcx('a', 'b')}*100<=a.cw*38)),
into_main AS (SELECT a.page_id, a.region_id, a.box_id, b.box_id AS main, row_number() OVER (PARTITION BY a.page_id, a.region_id, a.box_id ORDER BY {dcx('a', 'b')}, b.box_id) AS k
 FROM lone a JOIN bx b ON b.page_id=a.page_id AND b.region_id=a.region_id AND NOT b.small AND {oy('a', 'b')}>0 AND {dcx('a', 'b')}*100>=a.cw*38 AND {dcx('a', 'b')}*100<=a.cw*140),
clean AS (SELECT x.page_id, x.region_id, coalesce(main, x.box_id) AS box_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, min(cw) AS cw FROM bx x LEFT JOIN into_main i ON i.page_id=x.page_id AND i.region_id=x.region_id AND i.box_id=x.box_id AND k=1 GROUP BY ALL)"""
START = """start AS (SELECT c.page_id, c.region_id, CAST((c.l+c.r)//2 AS BIGINT) AS id, count(*) AS n, CAST(count(*)*((c.l+c.r)//2) AS BIGINT) AS s, min(c.l) AS l, min(c.t) AS t, max(c.r) AS r, max(c.b) AS b, any_value(un.cw) AS cw, any_value(most) AS most
 FROM clean c JOIN un USING (page_id, region_id) GROUP BY c.page_id, c.region_id, (c.l+c.r)//2)"""
CWALK = """cwalk AS (SELECT 0 AS step, *, true AS more FROM start UNION ALL
 (WITH g AS (SELECT page_id, region_id, id, n, s, l, t, r, b, cw, most, step, s/n AS mean, count(*) OVER p AS cnt, max(b-t) OVER p AS high,
   lead(s/n) OVER o AS m2, lead(n) OVER o AS n2, lead(l) OVER o AS l2, lead(t) OVER o AS t2, lead(r) OVER o AS r2, lead(b) OVER o AS b2
   FROM cwalk WHERE more WINDOW p AS (PARTITION BY page_id, region_id), o AS (PARTITION BY page_id, region_id ORDER BY s/n, id)),
  f AS (SELECT *, m2-mean AS gap, CASE WHEN m2 IS NULL THEN NULL
   WHEN ((m2-mean)*100<=cw*75 AND (greatest(r,r2)-least(l,l2))*100<=cw*170) OR (least(r-l,r2-l2)>0 AND greatest(least(r,r2)-greatest(l,l2),0)*100>=least(r-l,r2-l2)*35 AND (greatest(r,r2)-least(l,l2))*100<=cw*185) THEN 1
   WHEN (m2-mean)*100<cw*115 THEN 2
   WHEN most=1 OR ((((b-t)*100<greatest(cw*125,high*35) AND n<=2) OR ((b2-t2)*100<greatest(cw*125,high*35) AND n2<=2)) AND (m2-mean)*100<=cw*140) THEN 3
   WHEN cnt>most THEN 4 END AS rule FROM g),
  h AS (SELECT *, min(rule) OVER (PARTITION BY page_id, region_id) AS lowest FROM f),
  i AS (SELECT *, CASE WHEN rule=lowest THEN {'gap': gap, 'id': id} END AS gg FROM h),
  j AS (SELECT *, gg IS NOT NULL AND coalesce(gg<lag(gg) OVER o, true) AND coalesce(gg<lead(gg) OVER o, true) AS low FROM i WINDOW o AS (PARTITION BY page_id, region_id ORDER BY mean, id)),
  k AS (SELECT *, low AND (lowest<4 OR row_number() OVER (PARTITION BY page_id, region_id ORDER BY low DESC, gap, id)<=cnt-most) AS joins FROM j),
  q AS (SELECT *, CASE WHEN lag(joins, 1, false) OVER o THEN lag(id) OVER o ELSE id END AS to_id FROM k WINDOW o AS (PARTITION BY page_id, region_id ORDER BY mean, id))
  SELECT step+1, page_id, region_id, to_id, CAST(sum(n) AS BIGINT), CAST(sum(s) AS BIGINT), min(l), min(t), max(r), max(b), min(cw), min(most), bool_or(lowest IS NOT NULL) FROM q GROUP BY step, page_id, region_id, to_id)),
cfin AS (SELECT * FROM cwalk WHERE (page_id, region_id, step) IN (SELECT (page_id, region_id, max(step)) FROM cwalk GROUP BY page_id, region_id))"""
GROUND = """g1 AS (SELECT c.page_id, c.region_id, c.id, c.n, c.l, c.r, s/n AS mean, c.cw, greatest(16, CAST(floor(c.cw*75/100) AS INT)) AS least_w, s//n AS cx, gl, gr, greatest(c.t,gt) AS ct, least(c.b,gb) AS cb FROM cfin c JOIN un USING (page_id, region_id)),
g2 AS (SELECT *, greatest(least(cx-half,l),gl) AS cl, least(greatest(cx+half,r),gr) AS cr FROM (SELECT *, CAST(floor(least(greatest(CAST(floor(cw*108/100) AS INT),least_w),56)/2) AS INT) AS half FROM g1)),
g3 AS (SELECT *, CASE WHEN least_w-(cr-cl)>0 AND gr-gl>=least_w THEN least_w-(cr-cl) ELSE 0 END AS lack FROM g2),
g4 AS (SELECT * REPLACE (cl-more AS cl, cr+least(lack-more, greatest(0,gr-cr)) AS cr) FROM (SELECT *, least(lack//2, greatest(0,cl-gl)) AS more FROM g3)),
g5 AS (SELECT *, (cl+cr)//2 AS mid FROM g4 WHERE cr-cl>=8 AND cb-ct>=12),
g6 AS (SELECT *, lead(cl) OVER o AS cl2, lead(ct) OVER o AS ct2, lead(cr) OVER o AS cr2, lead(cb) OVER o AS cb2, lead(l) OVER o AS l2, lead(mean) OVER o AS mean2, row_number() OVER o AS column_no FROM g5 WINDOW o AS (PARTITION BY page_id, region_id ORDER BY mid, id)),
g7 AS (SELECT *, CAST(CASE WHEN r<=l2 THEN (r+l2)//2 ELSE floor((mean+mean2)/2) END AS INT) AS seam FROM g6),
g8 AS (SELECT *, CASE WHEN least(cb,cb2)>greatest(ct,ct2) AND cr>cl2 THEN CASE WHEN cl+least_w<=cr2-least_w THEN least(greatest(seam,cl+least_w),cr2-least_w) ELSE (cl+cr2)//2 END END AS cut FROM g7),
res AS (SELECT page_id, region_id, column_no, CAST(greatest(cl, lag(cut) OVER (PARTITION BY page_id, region_id ORDER BY mid, id)) AS INT) AS l, CAST(ct AS INT) AS t, CAST(least(cr,cut) AS INT) AS r, CAST(cb AS INT) AS b, n AS n_boxes FROM g8)"""


def region_boxes(t):
    """Boxes with the region that holds most of them, its frame, and the page's width unit."""
    owned = J.max_intersection(plain(t), t.regions, frame=True).where("region_id IS NOT NULL")
    unit = A.page_char_width(t.boxes).withColumnRenamed("char_width", "cw")
    return owned.select("page_id", "region_id", "box_id", *"ltrb", *[f"g{s}" for s in "ltrb"]).join(unit, "page_id")


@query("grp_columns_in_region", uses="boxes regions", also=",\n".join([COLS, rounds_sql(
    "cut", "box_id", "l, t, r, b", f"{min_area('a', 'b')}>0 AND {inter('a', 'b')}*100>=40*{min_area('a', 'b')}", [f"-{inter('a', 'b')}"], ENCLOSING, keys="page_id, region_id"), RUBY, START, CWALK, GROUND]),
    sql="SELECT * FROM res")
def _(t):
    return R.columns_in_region(region_boxes(t))


def frame(x): return f"{{'l':{x}.gl,'t':{x}.gt,'r':{x}.gr,'b':{x}.gb}}"


COVERS = f"({holds('{1}', '{0}')} OR ({area('{0}')}>0 AND {inter('{0}', '{1}')}*100>=35*{area('{0}')}))"
REC_FRAME = f"(SELECT *, {frame('st')} AS f FROM st WHERE kind='B')"
IN_HALF = "CAST(floor(cw*54/100) AS INT)"


@query("grp_reconcile_uncovered", uses="lines boxes regions", also=f"""
cw0 AS (SELECT page_id, CAST(least(greatest(coalesce(list_sort(list(r-l) FILTER (WHERE b-t>=16 AND r-l>=12))[count(*) FILTER (WHERE b-t>=16 AND r-l>=12)//2+1],26),18),48) AS INT) AS cw FROM boxes GROUP BY page_id),
bx AS (SELECT page_id, box_id, CASE conf_m%3 WHEN 0 THEN 'BUBBLED' WHEN 1 THEN 'ORPHAN' ELSE 'SFX' END AS category, l, t, r, b, cw FROM boxes JOIN cw0 USING (page_id)),
open_ AS (SELECT * FROM bx x WHERE NOT EXISTS (SELECT 1 FROM lines y WHERE y.page_id=x.page_id AND {COVERS.format('x', 'y')})),
own AS (SELECT x.page_id, x.box_id, g.region_id, g.l AS gl, g.t AS gt, g.r AS gr, g.b AS gb, row_number() OVER (PARTITION BY x.page_id, x.box_id ORDER BY {inter('x', 'g')} DESC, g.region_id) AS k
 FROM open_ x JOIN regions g ON g.page_id=x.page_id AND {inter('x', 'g')}>0 AND ({holds('g', 'x')} OR {inter('x', 'g')}*100>=35*{area('x')})),
st AS (SELECT 0 AS step, page_id, 'L' AS kind, 0 AS origin, line_id AS id, category, l, t, r, b, CAST(NULL AS BIGINT) AS region_id, 0 AS gl, 0 AS gt, 0 AS gr, 0 AS gb, 0 AS cw FROM lines WHERE page_id IN (SELECT page_id FROM open_)
 UNION ALL SELECT 0, o.page_id, 'B', 1, o.box_id, category, l, t, r, b, region_id, gl, gt, gr, gb, cw FROM open_ o LEFT JOIN own ON own.page_id=o.page_id AND own.box_id=o.box_id AND k=1
 UNION ALL
 (WITH x AS {REC_FRAME}, y AS (SELECT * FROM st WHERE kind='L'),
  tg AS (SELECT x.page_id, x.id, min({{'o': y.origin, 'i': y.id}}) AS t FROM x JOIN y ON x.page_id=y.page_id AND CASE WHEN x.region_id IS NOT NULL
    THEN y.category='BUBBLED' AND ({holds('x.f', 'y')} OR {inter('x.f', 'y')}>0) AND {dcx('x', 'y')}*100<=x.cw*75 ELSE y.category<>'BUBBLED' AND {dcx('x', 'y')}*100<=x.cw*80 AND {gy('x', 'y')}<=x.cw*2 END GROUP BY ALL),
  fr AS (SELECT * FROM x ANTI JOIN tg USING (page_id, id)),
  bl AS (SELECT DISTINCT b.page_id, b.id FROM fr a JOIN fr b ON a.page_id=b.page_id AND a.id<b.id AND CASE WHEN a.region_id IS NOT NULL THEN coalesce(a.region_id=b.region_id, false) AND {dcx('a', 'b')}*100<=a.cw*75
    ELSE b.region_id IS NULL AND {dcx('a', 'b')}*100<=a.cw*80 AND {gy('a', 'b')}<=a.cw*2 END),
  al AS (SELECT page_id, origin, id, max(category) AS category, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM (SELECT page_id, origin, id, category, l, t, r, b FROM y WHERE page_id IN (SELECT page_id FROM x)
     UNION ALL SELECT x.page_id, tg.t.o, tg.t.i, NULL, x.l, x.t, x.r, x.b FROM x JOIN tg ON tg.page_id=x.page_id AND tg.id=x.id) GROUP BY page_id, origin, id
   UNION ALL SELECT page_id, 1, id, CASE WHEN region_id IS NOT NULL THEN 'BUBBLED' WHEN category='SFX' THEN 'SFX' ELSE 'ORPHAN' END,
    CASE WHEN region_id IS NULL THEN l ELSE greatest(gl, least((l+r)//2-{IN_HALF}, l)) END, CASE WHEN region_id IS NULL THEN t ELSE greatest(gt, t) END,
    CASE WHEN region_id IS NULL THEN r ELSE least(gr, greatest((l+r)//2+{IN_HALF}, r)) END, CASE WHEN region_id IS NULL THEN b ELSE least(gb, b) END FROM fr ANTI JOIN bl USING (page_id, id)),
  lb AS (SELECT * FROM fr SEMI JOIN bl USING (page_id, id)),
  ul AS (SELECT * FROM lb a WHERE NOT EXISTS (SELECT 1 FROM al b WHERE b.page_id=a.page_id AND {COVERS.format('a', 'b')}))
  SELECT (SELECT max(step)+1 FROM st), page_id, 'L', origin, id, category, l, t, r, b, NULL, 0, 0, 0, 0, 0 FROM al
  UNION ALL SELECT step+1, page_id, 'B', 1, id, category, l, t, r, b, region_id, gl, gt, gr, gb, cw FROM ul)),
ends AS (SELECT page_id, origin, id AS line_id, category, l, t, r, b FROM st WHERE kind='L' AND (page_id, step) IN (SELECT (page_id, max(step)) FROM st GROUP BY page_id)
 UNION ALL SELECT page_id, 0, line_id, category, l, t, r, b FROM lines WHERE page_id NOT IN (SELECT page_id FROM open_)),
ink AS (SELECT g.page_id, g.region_id, g.l AS gl, g.t AS gt, g.r AS gr, g.b AS gb, min(x.l) AS l, min(x.t) AS t, max(x.r) AS r, max(x.b) AS b, min(x.cw) AS cw FROM bx x JOIN regions g ON g.page_id=x.page_id
 AND ({holds('g', 'x')} OR ({inter('x', 'g')}>0 AND {inter('x', 'g')}*100>={area('x')}*45)) GROUP BY ALL),
bare AS (SELECT * FROM ink i WHERE NOT EXISTS (SELECT 1 FROM ends y JOIN regions g ON g.page_id=y.page_id AND g.region_id=i.region_id WHERE y.page_id=i.page_id AND y.category='BUBBLED' AND ({holds('g', 'y')} OR {inter('g', 'y')}>0)))""",
       sql=f"""SELECT * FROM ends UNION ALL SELECT page_id, 2, region_id, 'BUBBLED', greatest(gl, least((l+r)//2-{IN_HALF}, l)), greatest(gt, t), least(gr, greatest((l+r)//2+{IN_HALF}, r)), least(gb, b) FROM bare""")
def _(t):
    return R.reconcile_uncovered(t.lines, kind_boxes(t), t.regions)


def kind_boxes(t):
    kind = F.element_at(F.array(F.lit("BUBBLED"), F.lit("ORPHAN"), F.lit("SFX")), F.col("conf_m") % 3 + 1)
    return sized_boxes(t).withColumn("category", kind)
