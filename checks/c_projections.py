from pyspark.sql import functions as F

from checks.registry import query
from checks.sqlgeo import *
from pagelattice.functions import geometry as G
from pagelattice.operators import filters as FL, joins as J, ordering as O, projections as P
from pagelattice.operators.pagefold import greedy_keep

W, H = 512, 800


@query("page_reading_summary", uses="boxes regions", also=f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY conf_m DESC, box_id) AS k FROM boxes),
clash AS (SELECT a.page_id, a.k AS hi, b.k AS lo FROM ranked a JOIN ranked b ON a.page_id=b.page_id AND a.k<b.k AND {iou_over('a','b',35)}),
scan AS (SELECT page_id, 0 AS step, CAST([] AS BIGINT[]) AS kept, max(k) AS n FROM ranked GROUP BY page_id
 UNION ALL SELECT s.page_id, s.step+1, CASE WHEN EXISTS (SELECT 1 FROM clash c WHERE c.page_id=s.page_id AND c.lo=s.step+1 AND list_contains(s.kept,c.hi)) THEN s.kept ELSE list_append(s.kept, s.step+1) END, s.n FROM scan s WHERE s.step<s.n),
kept AS (SELECT r.* FROM scan s JOIN ranked r ON r.page_id=s.page_id AND list_contains(s.kept, r.k) WHERE s.step=s.n),
cand AS (SELECT a.*, g.region_id, {inter('a','g')} AS i, {area('a')} AS ba,
  greatest(a.r-g.r,0)+greatest(g.l-a.l,0) AS ex, {holds('g','a')} AS inside, {holds('g','a',4)} AS near, {w('a')} AS bw
  FROM kept a JOIN regions g ON a.page_id=g.page_id AND {inter('a','g')}>0),
ok AS (SELECT *, row_number() OVER (PARTITION BY page_id, box_id ORDER BY i DESC, region_id) AS rn FROM cand
  WHERE (inside AND (i*100>=45*ba OR (i*100>=60*ba AND ex<=greatest(12, bw//4)) OR i*100>=85*ba)) OR (near AND i*100>=70*ba)),
done AS (SELECT k.*, o.region_id FROM kept k LEFT JOIN ok o ON o.page_id=k.page_id AND o.box_id=k.box_id AND o.rn=1)
""", sql=f"""
SELECT page_id, count(region_id) AS n_inside, CAST(sum(CASE WHEN region_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_outside,
 first(box_id ORDER BY {cy('d')}//200, -{cx('d')}, box_id) FILTER (WHERE region_id IS NOT NULL) AS first_box,
 first(box_id ORDER BY {cy('d')}//200 DESC, -{cx('d')} DESC, box_id DESC) FILTER (WHERE region_id IS NOT NULL) AS last_box
FROM done d GROUP BY page_id""")
def page_reading_summary(t):
    kept = greedy_keep(t.boxes, lambda k, x: G.iou_over(k, x, 35),
                       order={"_s": -F.col("conf_m"), "_o": F.col("box_id")}, row_id="box_id")
    placed = J.max_intersection(kept, t.regions)
    return O.page_summary(placed)


@query("rect_metrics", uses="boxes", sql=f"""
SELECT page_id, box_id, {w('x')} AS width, {h('x')} AS height, {area('x')} AS area, {cx('x')} AS cx, {cy('x')} AS cy FROM boxes x""")
def _(t):
    return P.rect_metrics(t.boxes.select("page_id", "box_id", "l", "t", "r", "b")).drop("l", "t", "r", "b")


@query("pair_overlap", uses="boxes regions", sql=f"""
SELECT a.page_id, a.box_id, g.region_id, {inter('a','g')} AS inter, round({inter('a','g')}/{union_area('a','g')},9) AS iou,
 round({inter('a','g')}/{min_area('a','g')},9) AS containment, round({inter('a','g')}/{area('a')},9) AS ioa
FROM boxes a JOIN regions g ON a.page_id=g.page_id AND {inter('a','g')}>0""")
def _(t):
    d = P.pair_overlap(t.boxes.select("page_id", "box_id", *"ltrb"), t.regions, "box_id", "region_id")
    return d.withColumns({c: F.round(c, 9) for c in ("iou", "containment", "ioa")})


@query("pair_gaps", uses="boxes", sql=f"""
SELECT a.page_id, a.box_id, b.box_id2, {gx('a','b')} AS gap_x, {gy('a','b')} AS gap_y, {ox('a','b')} AS h_overlap, {oy('a','b')} AS v_overlap,
 {dcx('a','b')} AS dcx, {dcy('a','b')} AS dcy FROM boxes a JOIN (SELECT *, box_id AS box_id2 FROM boxes) b
 ON a.page_id=b.page_id AND a.box_id<b.box_id2 AND {gx('a','b')}<=40 AND {gy('a','b')}<=40""")
def _(t):
    b = t.boxes.select("page_id", "box_id", *"ltrb")
    return P.pair_gaps(b, b.withColumnRenamed("box_id", "box_id2"), "box_id", "box_id2", 40).where("box_id < box_id2")


@query("rescale_boxes", uses="boxes", sql=f"""
SELECT * FROM (SELECT page_id, box_id, greatest(0,CAST(floor((2.0*l-(r-l))*512/640) AS INT)) AS l, greatest(0,CAST(floor((2.0*t-(b-t))*800/640) AS INT)) AS t,
 least(512,CAST(floor((2.0*l+(r-l))*512/640) AS INT)) AS r, least(800,CAST(floor((2.0*t+(b-t))*800/640) AS INT)) AS b FROM boxes) WHERE r-l>=20 AND b-t>=20""")
def _(t):
    raw = t.boxes.select("page_id", "box_id", (F.col("l") * 2).alias("mx"), (F.col("t") * 2).alias("my"),
                         ((F.col("r") - F.col("l")) * 2).alias("mw"), ((F.col("b") - F.col("t")) * 2).alias("mh"))
    return P.rescale_boxes(raw, 640, W, H).select("page_id", "box_id", *"ltrb")


@query("letterbox_inverse", uses="manifest points", also="""
s AS (SELECT crop_key, px0, py0, crop_w, crop_h, least(640.0::DOUBLE/crop_h, 640.0::DOUBLE/crop_w) AS sc FROM points JOIN manifest USING (crop_key))""", sql="""
SELECT crop_key, (px0 - floor((640-round_even(crop_w*sc,0))/2))/sc AS x, (py0 - floor((640-round_even(crop_h*sc,0))/2))/sc AS y FROM s""")
def _(t):
    d = t.points.select("crop_key", F.col("px0").alias("x"), F.col("py0").alias("y")).join(t.manifest.select("crop_key", "crop_w", "crop_h"), "crop_key")
    return P.letterbox_inverse(d, [("x", "y")], "crop_w", "crop_h").select("crop_key", "x", "y")


def _crop_sql(lo, hi):
    return f"""SELECT page_id, region_id, pad, greatest(0,l-pad) AS crop_l, greatest(0,t-pad) AS crop_t, least(512,r+pad) AS crop_r, least(800,b+pad) AS crop_b
FROM (SELECT *, CAST(least(greatest(round_even({lo}+(greatest(r-l,b-t)-150)*4.0::DOUBLE/350.0::DOUBLE,0),{lo}),{hi}) AS INT) AS pad FROM regions)"""


@query("adaptive_crop", uses="regions", sql=_crop_sql(12, 16))
def _(t):
    return P.adaptive_crop(t.regions, 12, 16, W, H).drop("l", "t", "r", "b")


@query("adaptive_crop_tight", uses="regions", sql=_crop_sql(10, 14))
def _(t):
    return P.adaptive_crop(t.regions, 10, 14, W, H).drop("l", "t", "r", "b")


@query("probe_crop", uses="boxes", sql="""
SELECT page_id, box_id, pl AS probe_l, pt AS probe_t, least(greatest(r+px,pl+1),512) AS probe_r, least(greatest(b+py,pt+1),800) AS probe_b
FROM (SELECT *, least(greatest(l-px,0),511) AS pl, least(greatest(t-py,0),799) AS pt FROM
 (SELECT *, least(greatest((r-l)//5,2),12) AS px, least(greatest((b-t)//5,2),12) AS py FROM boxes))""")
def _(t):
    return P.probe_crop(t.boxes, W, H).select("page_id", "box_id", "probe_l", "probe_t", "probe_r", "probe_b")


@query("canonical_points", uses="points", sql="""
SELECT crop_key, least(x0,x1) AS x0, CASE WHEN x0=x1 THEN least(y0,y1) WHEN x0<x1 THEN y0 ELSE y1 END AS y0,
 greatest(x0,x1) AS x1, CASE WHEN x0=x1 THEN greatest(y0,y1) WHEN x0<x1 THEN y1 ELSE y0 END AS y1 FROM points""")
def _(t):
    return P.canonical_points(t.points).select("crop_key", "x0", "y0", "x1", "y1")


AUGMENT = """
base AS (SELECT crop_key, x0,y0,x1,y1, crop_w, crop_h FROM points JOIN manifest USING (crop_key) WHERE is_conjoined AND NOT is_discarded),
v(variant, deg) AS (VALUES ('original',0.0::DOUBLE),('mirror',0.0::DOUBLE),('rot_p6',6.0::DOUBLE),('rot_m6',-6.0::DOUBLE),('rot_p12',12.0::DOUBLE),('rot_m12',-12.0::DOUBLE),('photometric',0.0::DOUBLE)),
size AS (SELECT *, radians(deg) AS a, CASE WHEN deg=0 THEN crop_w ELSE CAST(floor(crop_h*abs(sin(radians(deg)))+crop_w*abs(cos(radians(deg)))) AS INT) END AS out_w,
 CASE WHEN deg=0 THEN crop_h ELSE CAST(floor(crop_w*abs(sin(radians(deg)))+crop_h*abs(cos(radians(deg)))) AS INT) END AS out_h FROM base CROSS JOIN v),
turned AS (SELECT crop_key, variant, out_w, out_h,
 round(CASE WHEN variant='mirror' THEN crop_w-1-x0 WHEN deg=0 THEN x0 ELSE cos(a)*(x0-crop_w/2)+sin(a)*(y0-crop_h/2)+out_w/2 END,6) AS ax,
 round(CASE WHEN deg=0 THEN y0 ELSE cos(a)*(y0-crop_h/2)-sin(a)*(x0-crop_w/2)+out_h/2 END,6) AS ay,
 round(CASE WHEN variant='mirror' THEN crop_w-1-x1 WHEN deg=0 THEN x1 ELSE cos(a)*(x1-crop_w/2)+sin(a)*(y1-crop_h/2)+out_w/2 END,6) AS bx,
 round(CASE WHEN deg=0 THEN y1 ELSE cos(a)*(y1-crop_h/2)-sin(a)*(x1-crop_w/2)+out_h/2 END,6) AS by_ FROM size),
augmented AS (SELECT crop_key, variant, out_w, out_h, CASE WHEN s THEN bx ELSE ax END AS x0, CASE WHEN s THEN by_ ELSE ay END AS y0,
 CASE WHEN s THEN ax ELSE bx END AS x1, CASE WHEN s THEN ay ELSE by_ END AS y1 FROM (SELECT *, (bx<ax OR (bx=ax AND by_<ay)) AS s FROM turned))"""


@query("augment_points", uses="points manifest", also=AUGMENT, sql="SELECT * FROM augmented")
def _(t):
    d = t.points.select("crop_key", "x0", "y0", "x1", "y1").join(
        t.manifest.where("is_conjoined AND NOT is_discarded").select("crop_key", "crop_w", "crop_h"), "crop_key")
    return P.augment_points(d).drop("crop_w", "crop_h")


CUTS = """cuts AS (SELECT *, CASE WHEN region_id%2=0 THEN l ELSE CAST(l+(r-l)//2-region_id%9 AS INT) END AS p1x, CASE WHEN region_id%2=0 THEN CAST(t+(b-t)//2-region_id%11 AS INT) ELSE t END AS p1y,
 CASE WHEN region_id%2=0 THEN r ELSE CAST(l+(r-l)//2+region_id%13 AS INT) END AS p2x, CASE WHEN region_id%2=0 THEN CAST(t+(b-t)//2+region_id%7 AS INT) ELSE b END AS p2y FROM regions)"""


def cuts(t, regions=None):
    mx, my = F.floor((F.col("r") - F.col("l")) / 2), F.floor((F.col("b") - F.col("t")) / 2)
    even, rid = F.col("region_id") % 2 == 0, F.col("region_id")
    return (t.regions if regions is None else regions).withColumns({
        "p1x": F.when(even, F.col("l")).otherwise(F.col("l") + mx - rid % 9).cast("int"),
        "p1y": F.when(even, F.col("t") + my - rid % 11).otherwise(F.col("t")).cast("int"),
        "p2x": F.when(even, F.col("r")).otherwise(F.col("l") + mx + rid % 13).cast("int"),
        "p2y": F.when(even, F.col("t") + my + rid % 7).otherwise(F.col("b")).cast("int")})


def _side(x, y): return f"(({x}-p1x)*(p2y-p1y)-({y}-p1y)*(p2x-p1x))"


IN_CUT = f"""inl AS (SELECT x.page_id, x.line_id, x.l, x.t, x.r, x.b, c.region_id, p1x,p1y,p2x,p2y FROM lines x JOIN cuts c ON x.page_id=c.page_id AND {holds('c','x')})"""


@query("half_plane", uses="lines regions", also=CUTS + ",\n" + IN_CUT, sql=f"""
SELECT page_id, region_id, line_id, CASE WHEN {_side('(l+r)//2','(t+b)//2')}>=0 THEN 'A' ELSE 'B' END AS lobe FROM inl""")
def _(t):
    return P.half_plane(t.lines, cuts(t))


@query("straddle_class", uses="lines regions", also=CUTS + ",\n" + IN_CUT + f""",
med AS (SELECT page_id, region_id, quantile_cont(r-l,0.5) AS mw, quantile_cont(b-t,0.5) AS mh FROM inl GROUP BY ALL),
vot AS (SELECT inl.*, mw, mh, CAST({_side('l','t')}>=0 AS INT)+CAST({_side('r','t')}>=0 AS INT)+CAST({_side('l','b')}>=0 AS INT)+CAST({_side('r','b')}>=0 AS INT) AS votes FROM inl JOIN med USING (page_id, region_id))""", sql=f"""
SELECT page_id, region_id, line_id, votes, CASE WHEN votes>=3 THEN 'A' WHEN votes<=1 THEN 'B' WHEN {_side('(l+r)//2','(t+b)//2')}>=0 THEN 'A' ELSE 'B' END AS lobe,
 votes=2 AND CASE WHEN abs(p2y-p1y)>=abs(p2x-p1x) THEN (r-l)>=1.3::DOUBLE*mw OR ((r-l)>=26 AND least(abs(l-p1x),abs(r-p1x))>=6)
   ELSE (b-t)>=1.3::DOUBLE*mh OR ((b-t)>=30 AND least(abs(t-p1y),abs(b-p1y))>=6) END AS joined_misread FROM vot""")
def _(t):
    return P.straddle_class(t.lines, cuts(t))


@query("block_shape", uses="dialogue", sql="""
SELECT page_id, line_no, round((40+length(text)%90)/greatest(length(text),1),9) AS sym_width, round((30+line_no*17%160)/greatest(length(text),1),9) AS sym_height,
 CASE WHEN (30+line_no*17%160)*10 > (40+length(text)%90)*13 THEN 90 ELSE 0 END AS angle FROM dialogue""")
def _(t):
    d = t.dialogue.withColumns({"l": F.lit(0), "t": F.lit(0), "r": (40 + F.length("text") % 90).cast("int"), "b": (30 + F.col("line_no") * 17 % 160).cast("int")})
    return P.block_shape(d).select("page_id", "line_no", F.round("sym_width", 9).alias("sym_width"), F.round("sym_height", 9).alias("sym_height"), "angle")


@query("neighbor_cells", uses="boxes regions", also=f"""
src AS (SELECT * FROM boxes WHERE r-l>=8 AND b-t>=8),
home AS (SELECT x.page_id, x.box_id, min(g.region_id) AS region_id FROM src x JOIN regions g ON x.page_id=g.page_id AND {cx('x')}>=g.l AND {cx('x')}<g.r AND {cy('x')}>=g.t AND {cy('x')}<g.b GROUP BY ALL),
raw AS (SELECT x.page_id, x.box_id, s.side, least(greatest(x.l+s.dx*(x.r-x.l),0),512) AS l, least(greatest(x.t+s.dy*(x.b-x.t),0),800) AS t, least(greatest(x.r+s.dx*(x.r-x.l),0),512) AS r, least(greatest(x.b+s.dy*(x.b-x.t),0),800) AS b, g.l AS gl, g.t AS gt, g.r AS gr, g.b AS gb
 FROM src x JOIN home USING (page_id, box_id) JOIN regions g ON g.page_id=home.page_id AND g.region_id=home.region_id CROSS JOIN (VALUES (0,-1,0),(1,1,0),(2,0,-1),(3,0,1)) s(side,dx,dy)),
cells AS (SELECT x.*, box_id*4+side AS cell_id FROM raw x WHERE r-l>=10 AND b-t>=10 AND {cx('x')}>=gl AND {cx('x')}<gr AND {cy('x')}>=gt AND {cy('x')}<gb
 AND NOT EXISTS (SELECT 1 FROM boxes o WHERE o.page_id=x.page_id AND {inter('o','x')}*100>25*{area('x')})),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cell_id) AS k FROM cells),
clash AS (SELECT a.page_id, a.k AS hi, b.k AS lo FROM numbered a JOIN numbered b ON a.page_id=b.page_id AND a.k<b.k AND {cont_over('a','b',50)}),
scan AS (SELECT page_id, 0 AS step, CAST([] AS BIGINT[]) AS kept, max(k) AS n FROM numbered GROUP BY page_id
 UNION ALL SELECT s.page_id, s.step+1, CASE WHEN EXISTS (SELECT 1 FROM clash c WHERE c.page_id=s.page_id AND c.lo=s.step+1 AND list_contains(s.kept,c.hi)) THEN s.kept ELSE list_append(s.kept, s.step+1) END, s.n FROM scan s WHERE s.step<s.n)""", sql="""
SELECT r.page_id, r.box_id, r.side, r.l, r.t, r.r, r.b FROM scan s JOIN numbered r ON r.page_id=s.page_id AND list_contains(s.kept, r.k) WHERE s.step=s.n""")
def _(t):
    return P.neighbor_cells(t.boxes.select("page_id", "box_id", *"ltrb"), t.regions, W, H).drop("cell_id")


@query("unclip_boxes", uses="boxes", sql="""
SELECT * FROM (SELECT page_id, box_id, l2 AS l, t2 AS t, least(greatest(CAST(floor((r1+1)*2.0+0.5) AS INT),l2+1),1024) AS r, least(greatest(CAST(floor((b1+1)*2.5+0.5) AS INT),t2+1),2000) AS b
 FROM (SELECT *, least(CAST(floor(l1*2.0+0.5) AS INT),1023) AS l2, least(CAST(floor(t1*2.5+0.5) AS INT),1999) AS t2 FROM
  (SELECT *, greatest(0,l-px) AS l1, greatest(0,t-py) AS t1, least(511,r+px) AS r1, least(799,b+py) AS b1 FROM
   (SELECT *, CAST(floor((r-l+1)*(1.6::DOUBLE-1)*0.5+0.5) AS INT) AS px, CAST(floor((b-t+1)*(1.6::DOUBLE-1)*0.5+0.5) AS INT) AS py FROM boxes WHERE conf_m>=550 AND box_id%17>=6))))
WHERE r-l>=6 AND b-t>=6""")
def _(t):
    d = t.boxes.select("page_id", "box_id", *"ltrb", (F.col("conf_m") / 1000.0).alias("score"), (F.col("box_id") % 17).alias("n_cells"))
    return P.unclip_boxes(d, 1.6, 2.0, 2.5, W, H).drop("score", "n_cells")


@query("flt_region_size", uses="boxes", sql="SELECT page_id, box_id FROM boxes WHERE r-l>=18 AND b-t>=22 AND (r-l)*(b-t)>=400")
def _(t):
    return FL.region_size(t.boxes).select("page_id", "box_id")


@query("flt_detection_sanity", uses="lines", sql="""
SELECT page_id, line_id FROM lines WHERE line_id%1000>=400 AND r-l>=10 AND b-t>=10 AND r-l<=512*0.65 AND b-t<=800*0.65 AND (r-l)*(b-t)<=512*800*0.25
 AND r-l<=(b-t)*3.5 AND b-t<=(r-l)*3.5""")
def _(t):
    return FL.detection_sanity(t.lines.withColumn("conf_m", F.col("line_id") % 1000), W, H).select("page_id", "line_id")


@query("flt_context_threshold", uses="boxes regions", sql=f"""
SELECT page_id, box_id, inside FROM (SELECT x.*, conf_m%5 AS n, EXISTS (SELECT 1 FROM regions g WHERE g.page_id=x.page_id AND {holds('g','x')}) AS inside FROM boxes x)
WHERE CASE WHEN inside THEN conf_m>=180 AND least(r-l,b-t)>=6 AND (n>=3 OR (n>=2 AND conf_m>=220)) ELSE conf_m>=220 AND least(r-l,b-t)>=8 AND n>=3 END""")
def _(t):
    d = t.boxes.withColumn("n_cells", F.col("conf_m") % 5)
    return FL.context_threshold(d, t.regions).select("page_id", "box_id", F.col("region_id").isNotNull().alias("inside"))


@query("flt_exclusion_zones", uses="boxes zones", sql=f"""
SELECT page_id, box_id FROM boxes x WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.page_id=x.page_id AND {inter('x','z')}>0)""")
def _(t):
    return FL.exclusion_zones(t.boxes.select("page_id", "box_id", *"ltrb"), t.zones).select("page_id", "box_id")


@query("flt_positive_pages", uses="zones", sql="""
SELECT p_partkey AS page_id FROM part WHERE p_partkey IN (SELECT page_id FROM zones)""")
def _(t):
    return FL.positive_pages(t.part.select(F.col("p_partkey").alias("page_id")), t.zones)


@query("flt_positive_pages_counts", uses="zones", sql="""
SELECT count(*) AS scanned, count(*) FILTER (WHERE p_partkey IN (SELECT page_id FROM zones)) AS kept, count(*) FILTER (WHERE p_partkey NOT IN (SELECT page_id FROM zones)) AS filtered FROM part""")
def _(t):
    return FL.page_filter_counts(t.part.select(F.col("p_partkey").alias("page_id")), t.zones)


@query("flt_eval_ready", uses="manifest", sql="SELECT bubble_id FROM manifest WHERE (status='verified' OR is_conjoined IS NOT NULL) AND NOT is_discarded")
def _(t):
    return FL.eval_ready(t.manifest).select("bubble_id")


@query("flt_script_glyphs", sql=r"""
SELECT doc_id, line_no, regexp_matches(s, '[\p{L}\p{Nd}]') AS has_glyphs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)),1)-1 AS line_no FROM documents)""")
def _(t):
    d = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "s"))
    return d.select("doc_id", "line_no", FL.script_glyphs(F.col("s")).alias("has_glyphs"))


@query("flt_genuine_lines", uses="lines", sql="SELECT page_id, line_id FROM lines WHERE b-t>=60 AND r-l>=14")
def _(t):
    return FL.genuine_lines(t.lines).select("page_id", "line_id")


@query("flt_genuine_lines_fallback", uses="boxes", sql="""
SELECT page_id, box_id FROM (SELECT *, min(tier) OVER (PARTITION BY page_id) AS best FROM
 (SELECT *, CASE WHEN b-t>=60 AND r-l>=14 THEN 0 WHEN b-t>=45 AND r-l>=12 THEN 1 ELSE 2 END AS tier FROM boxes)) WHERE tier<=best""")
def _(t):
    return FL.genuine_lines(t.boxes, fallback=True).select("page_id", "box_id")


@query("flt_gutter_barrier", uses="boxes zones", also="gut AS (SELECT page_id, list(l) AS xs FROM zones GROUP BY page_id)", sql=f"""
SELECT a.page_id, a.box_id, b.box_id AS box_id2 FROM boxes a JOIN boxes b ON a.page_id=b.page_id AND a.box_id<b.box_id AND {gx('a','b')}<=30 AND {gy('a','b')}<=30
WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.page_id=a.page_id AND z.l>least({cx('a')},{cx('b')}) AND z.l<greatest({cx('a')},{cx('b')}))""")
def _(t):
    return J.unbarred_pairs(t.boxes.select("page_id", "box_id", *"ltrb"), t.zones.select("page_id", F.col("l").alias("gutter_x")), reach=30)
