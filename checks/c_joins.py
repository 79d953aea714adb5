from pyspark.sql import functions as F

from checks.c_projections import H, W
from checks.registry import query
from checks.sqlgeo import *
from pagelattice.operators import joins as J


def plain(t):
    return t.boxes.select("page_id", "box_id", *"ltrb")


def assign_sql(src):
    return f"""cand AS (SELECT a.*, g.region_id, {inter('a','g')} AS i, {area('a')} AS ba,
  greatest(a.r-g.r,0)+greatest(g.l-a.l,0) AS ex, {holds('g','a')} AS inside, {holds('g','a',4)} AS near, {w('a')} AS bw
  FROM {src} a JOIN regions g ON a.page_id=g.page_id AND {inter('a','g')}>0),
ok AS (SELECT *, row_number() OVER (PARTITION BY page_id, box_id ORDER BY i DESC, region_id) AS rn FROM cand
  WHERE (inside AND (i*100>=45*ba OR (i*100>=60*ba AND ex<=greatest(12, bw//4)) OR i*100>=85*ba)) OR (near AND i*100>=70*ba)),
assigned AS (SELECT k.*, o.region_id FROM {src} k LEFT JOIN ok o ON o.page_id=k.page_id AND o.box_id=k.box_id AND o.rn=1)"""


@query("join_max_intersection", uses="boxes regions", also=assign_sql("boxes"), sql="SELECT page_id, box_id, region_id FROM assigned")
def _(t):
    return J.max_intersection(plain(t), t.regions).select("page_id", "box_id", "region_id")


@query("join_ioa_tiered", uses="boxes regions", also=f"""
best AS (SELECT a.*, g.region_id AS own, {inter('a','g')} AS i, {area('a')} AS ba,
 greatest(least(a.r,least(512,g.r+8))-greatest(a.l,greatest(0,g.l-8)),0)*greatest(least(a.b,least(800,g.b+8))-greatest(a.t,greatest(0,g.t-8)),0) AS gi,
 row_number() OVER (PARTITION BY a.page_id,a.box_id ORDER BY {inter('a','g')} DESC, g.region_id) AS rn FROM boxes a JOIN regions g ON a.page_id=g.page_id AND {inter('a','g')}>0),
tier AS (SELECT x.*, own, CASE WHEN i*100>=70*ba THEN 'strong' WHEN i*100>=35*ba THEN CASE WHEN gi*100>=60*ba THEN 'grown' ELSE 'nearest' END END AS tier
 FROM boxes x LEFT JOIN best ON best.page_id=x.page_id AND best.box_id=x.box_id AND rn=1),
near AS (SELECT x.page_id, x.box_id, arg_min(g.region_id, (({cx('x')}-{cx('g')})*({cx('x')}-{cx('g')})+({cy('x')}-{cy('g')})*({cy('x')}-{cy('g')}))*CAST(1000000000 AS BIGINT)+g.region_id) AS nid
 FROM tier x JOIN regions g USING (page_id) WHERE x.tier='nearest' GROUP BY ALL)""", sql="""
SELECT t.page_id, t.box_id, tier, CASE tier WHEN 'nearest' THEN nid WHEN 'strong' THEN own WHEN 'grown' THEN own END AS region_id FROM tier t LEFT JOIN near n ON n.page_id=t.page_id AND n.box_id=t.box_id""")
def _(t):
    return J.ioa_tiered(plain(t), t.regions, W, H).select("page_id", "box_id", "tier", "region_id")


@query("join_center_first", uses="boxes regions", sql=f"""
SELECT x.page_id, x.box_id, coalesce(min(g.region_id),-1) AS region_id FROM boxes x LEFT JOIN regions g ON g.page_id=x.page_id AND {holds('g','x')} GROUP BY x.page_id, x.box_id""")
def _(t):
    return J.center_first(plain(t), t.regions).select("page_id", "box_id", "region_id")


@query("join_center_or_overlap", uses="boxes regions", sql=f"""
SELECT x.page_id, x.box_id, coalesce(max(g.region_id),-1) AS region_id FROM boxes x LEFT JOIN regions g ON g.page_id=x.page_id AND ({holds('g','x')} OR {inter('x','g')}*100>=35*{area('x')}) GROUP BY x.page_id, x.box_id""")
def _(t):
    return J.center_or_overlap(plain(t), t.regions).select("page_id", "box_id", "region_id")


@query("join_exact_then_max", uses="lines regions", also="src AS (SELECT page_id, line_id, l,t,r,b FROM lines UNION ALL SELECT page_id, -1-region_id, l,t,r,b FROM regions)", sql=f"""
SELECT x.page_id, x.line_id, arg_min(g.region_id, [CASE WHEN x.l=g.l AND x.t=g.t AND x.r=g.r AND x.b=g.b THEN 0 ELSE 1 END, -{inter('x','g')}, g.region_id]) FILTER (WHERE {inter('x','g')}>0 OR (x.l=g.l AND x.t=g.t AND x.r=g.r AND x.b=g.b)) AS region_id
FROM src x LEFT JOIN regions g ON g.page_id=x.page_id GROUP BY x.page_id, x.line_id""")
def _(t):
    src = t.lines.select("page_id", "line_id", *"ltrb").unionByName(t.regions.select("page_id", (-1 - F.col("region_id")).alias("line_id"), *"ltrb"))
    return J.exact_then_max(src, t.regions).select("page_id", "line_id", "region_id")


COVER = f"({holds('y','x')} OR ({inter('x','y')}>0 AND {inter('x','y')}*100>=35*{area('x')}))"


@query("anti_uncovered", uses="boxes lines", sql=f"SELECT page_id, box_id FROM boxes x WHERE NOT EXISTS (SELECT 1 FROM lines y WHERE y.page_id=x.page_id AND {COVER})")
def _(t):
    return J.uncovered(plain(t), t.lines).select("page_id", "box_id")


@query("anti_suppress_lower", uses="lines", sql=f"""
SELECT page_id, line_id FROM lines x WHERE category<>'BUBBLED' AND r-l>=6 AND b-t>=6
AND NOT EXISTS (SELECT 1 FROM lines y WHERE y.page_id=x.page_id AND y.category='BUBBLED' AND {covered('x','y',50)})""")
def _(t):
    return J.suppress_lower(t.lines.where("category <> 'BUBBLED'"), t.lines.where("category = 'BUBBLED'")).select("page_id", "line_id")


EMPTY = f"""own AS (SELECT x.page_id, arg_min(g.region_id, [CASE WHEN x.l=g.l AND x.t=g.t AND x.r=g.r AND x.b=g.b THEN 0 ELSE 1 END, -{inter('x','g')}, g.region_id]) AS region_id
 FROM lines x JOIN regions g ON g.page_id=x.page_id AND {inter('x','g')}>0 WHERE category='BUBBLED' GROUP BY x.page_id, x.line_id),
bare AS (SELECT g.* FROM regions g WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.page_id=g.page_id AND own.region_id=g.region_id)),
open_boxes AS (SELECT * FROM boxes x WHERE NOT EXISTS (SELECT 1 FROM lines y WHERE y.category='BUBBLED' AND y.page_id=x.page_id AND {COVER})),
emptied AS (SELECT page_id, region_id FROM bare g WHERE EXISTS (SELECT 1 FROM open_boxes x WHERE x.page_id=g.page_id AND ({holds('g','x')} OR ({inter('x','g')}>0 AND {inter('x','g')}*100>=45*{area('x')}))))"""


@query("semi_empty_regions", uses="boxes lines regions", also=EMPTY, sql="SELECT * FROM emptied")
def _(t):
    return J.empty_regions(plain(t), t.lines, t.regions).select("page_id", "region_id")


@query("join_ctd_match", uses="boxes zones", also=f"""
c AS (SELECT *, box_id//6400 AS cluster_id FROM boxes),
f AS (SELECT x.*, EXISTS (SELECT 1 FROM zones e WHERE e.page_id=x.page_id AND e.r-e.l>=14 AND e.b-e.t>=14 AND (({holds('e','x')} AND {inter('x','e')}*100>=35*{area('x')}) OR ({holds('e','x',6)} AND {inter('x','e')}*100>=40*{area('x')}) OR {inter('x','e')}*100>=55*{area('x')})) AS hit FROM c x)""", sql="""
SELECT page_id, box_id, CASE WHEN bool_or(hit) OVER (PARTITION BY page_id, cluster_id) THEN 'ORPHAN' ELSE 'SFX' END AS category FROM f""")
def _(t):
    c = plain(t).withColumn("cluster_id", F.floor(F.col("box_id") / 6400))
    return J.ctd_match(c, t.zones).select("page_id", "box_id", "category")


@query("join_partial_overlap_report", uses="boxes regions", sql=f"""
SELECT a.page_id, g.region_id, a.box_id, {inter('a','g')}/{area('a')} AS ratio FROM boxes a JOIN regions g ON a.page_id=g.page_id WHERE {inter('a','g')}*100>=10*{area('a')} AND {inter('a','g')}*100<95*{area('a')}""")
def _(t):
    return J.partial_overlap_report(t.regions, plain(t))


@query("join_pred_truth", uses="manifest points", also="preds AS (SELECT * FROM points WHERE conf_conj_m>100)", sql="""
SELECT m.crop_key, m.is_conjoined, p.conf_conj_m, p.crop_key IS NOT NULL AS has_prediction FROM manifest m LEFT JOIN preds p USING (crop_key) WHERE (status='verified' OR is_conjoined IS NOT NULL) AND NOT is_discarded""")
def _(t):
    from pagelattice.operators.filters import eval_ready
    truth = eval_ready(t.manifest).select("crop_key", "is_conjoined")
    return J.pred_truth(truth, t.points.where("conf_conj_m > 100").select("crop_key", "conf_conj_m"))


SAMPLE = """sample AS (SELECT 't'||lpad(CAST(c_custkey AS VARCHAR),6,'0') AS sample_id, 'b'||lpad(CAST(c_custkey*3 AS VARCHAR),7,'0') AS original_id,
 CASE WHEN c_nationkey%3=0 THEN 'verified' ELSE 'unlabeled' END AS status, CASE WHEN c_nationkey%4=0 THEN c_custkey%2=0 END AS is_conjoined,
 c_nationkey%7=0 AS is_discarded, CASE WHEN c_nationkey%7=0 THEN c_mktsegment END AS discard_reason, 'day '||c_nationkey AS annotated_at FROM customer),
src AS (SELECT bubble_id, batch, is_conjoined, is_discarded, CAST(NULL AS VARCHAR) AS discard_reason, status, CAST(NULL AS VARCHAR) AS annotated_at FROM manifest),
merged AS (SELECT s.bubble_id, s.batch, n.sample_id IS NOT NULL AS synced, CASE WHEN n.sample_id IS NULL THEN s.is_conjoined ELSE n.is_conjoined END AS is_conjoined,
 CASE WHEN n.sample_id IS NULL THEN s.is_discarded ELSE n.is_discarded END AS is_discarded, n.discard_reason, coalesce(n.status,s.status) AS status, n.annotated_at
 FROM src s LEFT JOIN (SELECT * FROM sample WHERE status='verified' OR is_conjoined IS NOT NULL OR is_discarded) n ON n.original_id=s.bubble_id)"""


def sample_table(t):
    return t._spark.sql("WITH " + SAMPLE.split("FROM customer)")[0].replace("VARCHAR", "STRING") + "FROM {customer}) SELECT * FROM sample", customer=t.customer)


def sync_source(t):
    return t.manifest.select("bubble_id", "batch", "is_conjoined", "is_discarded", F.lit(None).cast("string").alias("discard_reason"), "status", F.lit(None).cast("string").alias("annotated_at"))


@query("merge_label_sync", uses="manifest", also=SAMPLE, sql="SELECT * FROM merged")
def _(t):
    return J.label_sync(sync_source(t), sample_table(t))


@query("merge_label_sync_counts", uses="manifest", also=SAMPLE, sql="""
SELECT count(*) FILTER (WHERE synced) AS synced, count(*) FILTER (WHERE synced AND is_discarded) AS discarded, count(*) FILTER (WHERE synced AND NOT is_discarded AND is_conjoined) AS conjoined, count(*) FILTER (WHERE synced AND NOT is_discarded AND NOT is_conjoined) AS single FROM merged""")
def _(t):
    return J.label_sync_counts(J.label_sync(sync_source(t), sample_table(t)))


@query("join_lineage", uses="manifest", sql="""
SELECT bubble_id, 'cbz_'||lpad(substr(split_part(page_name,'_',1),2),2,'0')||'.cbz' AS archive, coalesce(n_name,'Unknown') AS title
FROM manifest LEFT JOIN nation ON n_nationkey=CAST(substr(split_part(page_name,'_',1),2) AS INT)""")
def _(t):
    arch = t.nation.select(F.concat(F.lit("cbz_"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(".cbz")).alias("archive"), F.col("n_name").alias("title"))
    return J.lineage(t.manifest.select("bubble_id", "page_name"), arch).select("bubble_id", "archive", "title")


LISTING = """listing AS (SELECT c_custkey AS list_no, 'c'||lpad(CAST(c_custkey%20+1 AS VARCHAR),2,'0')||'_p'||CAST(c_custkey%400+1 AS VARCHAR)||'.webp' AS filename, c_mktsegment AS title, c_mktsegment AS series FROM customer)"""


def listing(t):
    return t._spark.sql("WITH " + LISTING.replace("VARCHAR", "STRING").replace("FROM customer", "FROM {customer}") + " SELECT * FROM listing", customer=t.customer)


def have(t):
    return t.manifest.select(F.col("page_name").alias("filename"))


@query("join_curated", uses="manifest", also=LISTING, sql="SELECT list_no, filename, title, 'b4_'||filename AS staged FROM listing WHERE filename IN (SELECT page_name FROM manifest)")
def _(t):
    return J.curated(listing(t), have(t), "b4").drop("series")


@query("join_curated_missing", uses="manifest", also=LISTING, sql="SELECT list_no, filename, title FROM listing WHERE filename NOT IN (SELECT page_name FROM manifest)")
def _(t):
    return J.curated_missing(listing(t), have(t)).drop("series")


@query("anti_new_sources", uses="files", sql="SELECT file_id, path FROM files WHERE contains(path,'/en/') AND path NOT IN (SELECT url FROM pages JOIN labels ON labels.doc_id=pages.page_id)")
def _(t):
    seen = t.pages.join(t.labels.select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select(F.col("url").alias("path"))
    return J.new_sources(t.files, seen, "/en/")


@query("join_nearest_snap", uses="manifest points candidates", also="""
p AS (SELECT crop_key, px0, py0, px1, py1, least(crop_w,crop_h) AS s FROM points JOIN manifest USING (crop_key)),
d0 AS (SELECT p.*, c.x AS sx0, c.y AS sy0 FROM p LEFT JOIN candidates c ON c.crop_key=p.crop_key AND ((c.x-px0)*(c.x-px0)+(c.y-py0)*(c.y-py0)<=2025 OR ((c.x-px0)*(c.x-px0)+(c.y-py0)*(c.y-py0))*10000<=144*s*s)
  QUALIFY row_number() OVER (PARTITION BY p.crop_key ORDER BY (c.x-px0)*(c.x-px0)+(c.y-py0)*(c.y-py0), c.point_id)=1),
d1 AS (SELECT d0.*, c.x AS sx1, c.y AS sy1 FROM d0 LEFT JOIN candidates c ON c.crop_key=d0.crop_key AND NOT coalesce(c.x=sx0 AND c.y=sy0,false) AND ((c.x-px1)*(c.x-px1)+(c.y-py1)*(c.y-py1)<=2025 OR ((c.x-px1)*(c.x-px1)+(c.y-py1)*(c.y-py1))*10000<=144*s*s)
  QUALIFY row_number() OVER (PARTITION BY d0.crop_key ORDER BY (c.x-px1)*(c.x-px1)+(c.y-py1)*(c.y-py1), c.point_id)=1)""", sql="""
SELECT crop_key, coalesce(sx0,px0) AS sx0, coalesce(sy0,py0) AS sy0, coalesce(sx1,px1) AS sx1, coalesce(sy1,py1) AS sy1 FROM d1""")
def _(t):
    p = t.points.select("crop_key", "px0", "py0", "px1", "py1").join(t.manifest.select("crop_key", "crop_w", "crop_h"), "crop_key")
    return J.nearest_snap(p, t.candidates).select("crop_key", "sx0", "sy0", "sx1", "sy1")


@query("join_best_pair", uses="manifest candidates", also="""
pr AS (SELECT p.crop_key, p.point_id AS i, q.point_id AS j, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, crop_w AS w, crop_h AS h, abs(p.x-q.x) AS dx, abs(p.y-q.y) AS dy, p.depth+q.depth AS d
 FROM candidates p JOIN candidates q ON p.crop_key=q.crop_key AND p.point_id<q.point_id JOIN manifest m ON m.crop_key=p.crop_key),
sc AS (SELECT *, round(d/(1+CASE WHEN h*100>w*115 THEN dy/(dx+0.0001::DOUBLE) WHEN w*100>h*115 THEN dx/(dy+0.0001::DOUBLE) ELSE 0 END),9) AS score FROM pr
 WHERE dx*dx+dy*dy>=400 AND CAST(dx*dx+dy*dy AS BIGINT)*10000<=CAST(greatest(w,h)*95 AS BIGINT)*(greatest(w,h)*95) AND CASE WHEN h*100>w*115 THEN dy*10<=dx*8 WHEN w*100>h*115 THEN dx*10<=dy*8 ELSE true END)""", sql="""
SELECT crop_key, score, ax, ay, bx, by_ AS "by" FROM sc QUALIFY row_number() OVER (PARTITION BY crop_key ORDER BY score DESC, i, j)=1""")
def _(t):
    return J.best_pair(t.candidates, t.manifest)


@query("join_best_deep_pair", uses="candidates", also="""
top AS (SELECT *, row_number() OVER (PARTITION BY crop_key ORDER BY depth DESC, point_id) AS rn FROM candidates QUALIFY rn<=8),
pr AS (SELECT p.crop_key, p.rn AS i, q.rn AS j, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, round((p.depth+q.depth)*sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)),6) AS sc, (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)>=900 AS ok
 FROM top p JOIN top q ON p.crop_key=q.crop_key AND p.rn<q.rn AND p.rn<=6)""", sql="""
SELECT crop_key, CASE WHEN ok THEN sc END AS score, ax, ay, bx, by_ AS "by" FROM pr WHERE ok OR (i=1 AND j=2)
QUALIFY row_number() OVER (PARTITION BY crop_key ORDER BY ok DESC, CASE WHEN ok THEN sc END DESC, i, j)=1""")
def _(t):
    return J.best_deep_pair(t.candidates)


@query("join_series_title", uses="manifest", also=LISTING, sql="""
SELECT bubble_id, coalesce(s, split_part(page_name,'_',1)) AS page_series FROM manifest LEFT JOIN (SELECT filename, max(title) AS s FROM listing GROUP BY filename) ON filename=page_name""")
def _(t):
    return J.series_title(t.manifest.select("bubble_id", F.col("page_name").alias("filename")), listing(t)).select("bubble_id", "page_series")


def _verified_points(t):
    pts = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    return t.points.where("conf_conj_m >= 500").select("crop_key", pts.alias("points"))


@query("join_review_item", uses="manifest points", sql="""
SELECT bubble_id, row_number() OVER (PARTITION BY batch ORDER BY crop_key) AS position, count(*) OVER (PARTITION BY batch) AS total, CASE WHEN p.crop_key IS NULL THEN 0 ELSE 2 END AS n_points, p.x1 AS last_x
FROM manifest m LEFT JOIN (SELECT * FROM points WHERE conf_conj_m>=500) p USING (crop_key)""")
def _(t):
    d = J.review_item(t.manifest.select("crop_key", "bubble_id", "batch"), _verified_points(t))
    return d.select("bubble_id", "position", "total", F.size("points").alias("n_points"), F.get("points", F.lit(1))["x"].alias("last_x"))


def _review(kind):
    cond = "coalesce(is_conjoined,false)" if kind == "conjoined" else "NOT coalesce(is_conjoined,false)"

    @query(f"join_review_item_{kind}", uses="manifest", sql=f"""
SELECT bubble_id, position FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY crop_key) AS position FROM manifest) WHERE status IN ('verified','annotated') AND NOT is_discarded AND {cond}""")
    def _(t):
        return J.review_list(t.manifest, kind).select("bubble_id", "position")


_review("conjoined")
_review("single")
