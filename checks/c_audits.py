from pyspark.sql import functions as F

from checks.c_joins import COVER, plain
from checks.c_projections import H, W
from checks.registry import query
from checks.sqlgeo import *
from pagelattice.operators import audits as A, joins as J, ordering as O

UNITS = "pw AS (SELECT page_id, coalesce(CAST(least(greatest(list_sort(list(r-l) FILTER (WHERE b-t>=16 AND r-l>=12))[count(*) FILTER (WHERE b-t>=16 AND r-l>=12)//2+1],18),48) AS INT),26) AS cw FROM boxes GROUP BY page_id)"
RUNITS = UNITS + f""",
med AS (SELECT g.page_id, g.region_id, quantile_cont(x.r-x.l,0.5) AS m FROM regions g JOIN boxes x ON x.page_id=g.page_id AND x.b-x.t>=16 AND x.r-x.l>=12 AND {holds('g','x')} GROUP BY ALL),
rw AS (SELECT g.page_id, g.region_id, coalesce(cw,26) AS cw, least(greatest(coalesce(m,coalesce(cw,26)),16),greatest(48,1.5*coalesce(cw,26))) AS lw FROM regions g LEFT JOIN pw USING (page_id) LEFT JOIN med USING (page_id, region_id))"""
OWN = RUNITS + f""",
own AS (SELECT x.*, g.region_id, g.l AS gl, g.t AS gt, g.r AS gr, g.b AS gb, {cx('x')} AS cx FROM lines x JOIN regions g ON g.page_id=x.page_id AND {inter('x','g')}>0 WHERE category='BUBBLED'
 QUALIFY row_number() OVER (PARTITION BY x.page_id, x.line_id ORDER BY {inter('x','g')} DESC, g.region_id)=1),
ow AS (SELECT own.*, lw FROM own JOIN rw USING (page_id, region_id))"""
FRAG = OWN + ",\nfrag AS (SELECT a.page_id, count(b.line_id) AS column_fragmentations FROM ow a LEFT JOIN ow b ON a.page_id=b.page_id AND a.region_id=b.region_id AND a.line_id<b.line_id AND abs(a.cx-b.cx)<=0.4*a.lw GROUP BY ALL)"
PITCH = OWN + """,
seq AS (SELECT *, lag(r) OVER w AS pr, lag(t) OVER w AS pt, lag(b) OVER w AS pb, lag(cx) OVER w AS pcx FROM ow WINDOW w AS (PARTITION BY page_id, region_id ORDER BY cx, line_id)),
pit AS (SELECT page_id, count(*) FILTER (WHERE least(b,pb)>greatest(t,pt) AND pr IS NOT NULL AND (cx-pcx<0.85*lw OR (pr>l AND cx-pcx<1.15*lw))) AS column_pitch_violations,
 count(*) FILTER (WHERE least(b,pb)>greatest(t,pt) AND pr>l) AS gutter_crossover_count FROM seq GROUP BY page_id)"""
CHOKE = OWN + """,
ex AS (SELECT *, greatest(gl-l,0) AS el, greatest(r-gr,0) AS er, greatest(gt-t,0) AS et, greatest(b-gb,0) AS eb FROM ow),
cho AS (SELECT page_id, count(*) FILTER (WHERE r-l<0.72*lw) AS width_choking_count, count(*) FILTER (WHERE greatest(el,er,et,eb)>4) AS boundary_bleed_count,
 CAST(sum(CASE WHEN greatest(el,er,et,eb)>4 THEN (el+er)*(et+eb) ELSE 0 END) AS BIGINT) AS boundary_bleed_area FROM ex GROUP BY page_id)"""
RUBY = "rub AS (SELECT page_id, count(*) FILTER (WHERE r-l<0.5*coalesce(cw,26) AND b-t>16) AS furigana_leaks FROM lines LEFT JOIN pw USING (page_id) GROUP BY page_id)"
PARTS = """parts AS (SELECT page_id, region_id, l, t, r, b, region_id%3=0 AS is_conjoined, l+5 AS p1x_raw, t+9 AS p1y_raw, CAST(l+5+region_id%50 AS INT) AS p1x, CAST(t+9+region_id%37 AS INT) AS p1y,
 r-5 AS p2x_raw, b-9 AS p2y_raw, CASE WHEN region_id%7>0 THEN r-6 END AS p2x, b-9 AS p2y, CAST(region_id%2 AS INT) AS n_split_lines FROM regions)"""
SNAP = PARTS + """,
sna AS (SELECT page_id, count(*) AS m3_conjoined_bubbles, CAST(sum(n_split_lines) AS BIGINT) AS m3_split_lines, count(*) FILTER (WHERE p2x IS NOT NULL AND (sqrt((p1x-p1x_raw)*(p1x-p1x_raw)+(p1y-p1y_raw)*(p1y-p1y_raw))>greatest(45,0.12*least(r-l,b-t)) OR abs(p2x-p2x_raw)>greatest(45,0.12*least(r-l,b-t)))) AS waist_snap_failures
 FROM parts WHERE is_conjoined GROUP BY page_id)"""


def parts(t):
    sql = PARTS.split("AS (", 1)[1][:-1].replace("FROM regions", "FROM {regions}")
    return t._spark.sql(sql, regions=t.regions)


def owned(t):
    return A.audited_lines(t.lines, t.regions, t.boxes)


@query("agg_char_width", uses="boxes", also=UNITS, sql="SELECT page_id, cw AS char_width FROM pw")
def _(t):
    return A.page_char_width(t.boxes)


@query("agg_char_width_region", uses="boxes regions", also=RUNITS, sql="SELECT page_id, region_id, CAST(lw*2 AS INT) AS local_width2 FROM rw")
def _(t):
    return A.region_char_width(t.boxes, t.regions, A.page_char_width(t.boxes)).select("page_id", "region_id", "local_width2")


@query("agg_group_bounds", uses="lines regions", also=f"o AS (SELECT x.*, (SELECT min(g.region_id) FROM regions g WHERE g.page_id=x.page_id AND {holds('g','x')}) AS region_id FROM lines x)", sql="""
SELECT o.page_id, o.region_id, count(*) AS n_lines, least(greatest(0,any_value(g.l),min(o.l)-10),min(o.l)) AS l, least(greatest(0,any_value(g.t),min(o.t)-10),min(o.t)) AS t,
 greatest(least(512,any_value(g.r),max(o.r)+10),max(o.r)) AS r, greatest(least(800,any_value(g.b),max(o.b)+10),max(o.b)) AS b
FROM o JOIN regions g ON g.page_id=o.page_id AND g.region_id=o.region_id GROUP BY o.page_id, o.region_id""")
def _(t):
    d = J.center_first(t.lines.select("page_id", "line_id", *"ltrb"), t.regions).where("region_id >= 0")
    return A.group_bounds(d, t.regions, W, H)


def _vote(name, pct):
    @query(name, uses="boxes", sql=f"""
SELECT page_id, box_id, CASE WHEN avg(CASE WHEN category='SFX' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY page_id, box_id//6400)>={pct / 100} THEN 'SFX' ELSE 'ORPHAN' END AS voted FROM boxes""")
    def _(t):
        d = t.boxes.select("page_id", "box_id", F.floor(F.col("box_id") / 6400).alias("cluster_id"), (F.col("category") == "SFX").alias("sfx_vote"))
        return A.cluster_vote(d, pct).select("page_id", "box_id", F.col("category").alias("voted"))


_vote("agg_cluster_vote", 65)
_vote("agg_cluster_vote_40", 40)


@query("agg_page_counts", uses="boxes", sql="""
SELECT page_id, count(*) FILTER (WHERE category='BUBBLED') AS "BUBBLED", count(*) FILTER (WHERE category='ORPHAN') AS "ORPHAN", count(*) FILTER (WHERE category='SFX') AS "SFX" FROM boxes GROUP BY page_id""")
def _(t):
    return A.page_counts(t.boxes, ["BUBBLED", "ORPHAN", "SFX"])


@query("agg_probe_outcomes", uses="dialogue", also="c AS (SELECT *, role='system' AS inr, CASE line_no%4 WHEN 0 THEN '  ' WHEN 1 THEN '?! -' ELSE text END AS probe FROM dialogue)", sql=r"""
SELECT page_id, count(*) FILTER (WHERE inr OR line_no%4>1 AND regexp_matches(probe,'[\p{L}\p{Nd}]')) AS kept, count(*) FILTER (WHERE NOT (inr OR regexp_matches(probe,'[\p{L}\p{Nd}]'))) AS dropped, count(*) FILTER (WHERE inr) AS n_exempt,
 count(*) FILTER (WHERE NOT inr AND regexp_matches(probe,'[\p{L}\p{Nd}]')) AS n_passed, count(*) FILTER (WHERE NOT inr AND trim(probe)='') AS n_blank,
 count(*) FILTER (WHERE NOT inr AND trim(probe)<>'' AND NOT regexp_matches(probe,'[\p{L}\p{Nd}]')) AS n_noise FROM c GROUP BY page_id""")
def _(t):
    probe = F.when(F.col("line_no") % 4 == 0, "  ").when(F.col("line_no") % 4 == 1, "?! -").otherwise(F.col("text"))
    return A.probe_outcomes(t.dialogue.select("page_id", "line_no", (F.col("role") == "system").alias("in_region"), probe.alias("text")))


@query("audit_fragmentation", uses="boxes lines regions", also=FRAG, sql="SELECT page_id, column_fragmentations FROM frag")
def _(t):
    return A.fragmentation(owned(t))


@query("audit_pitch_gutter", uses="boxes lines regions", also=PITCH, sql="SELECT * FROM pit")
def _(t):
    return A.pitch_and_gutter(owned(t))


@query("audit_choke_bleed", uses="boxes lines regions", also=CHOKE, sql="SELECT * FROM cho")
def _(t):
    return A.choke_and_bleed(owned(t))


@query("audit_ruby_leak", uses="boxes lines", also=UNITS + ",\n" + RUBY, sql="SELECT * FROM rub")
def _(t):
    return A.ruby_leaks(t.lines, A.page_char_width(t.boxes))


@query("audit_snap_failure", uses="regions", also=SNAP, sql="SELECT * FROM sna")
def _(t):
    return A.snap_failures(parts(t))


LEDGER = ",\n".join([FRAG] + [x[len(OWN) + 2:] for x in (PITCH, CHOKE)] + [RUBY, SNAP]) + f""",
lost AS (SELECT page_id, count(*) AS dropped_box_count FROM boxes x WHERE NOT EXISTS (SELECT 1 FROM lines y WHERE y.page_id=x.page_id AND {COVER}) GROUP BY page_id),
bare AS (SELECT g.* FROM regions g WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.page_id=g.page_id AND own.region_id=g.region_id)),
open_boxes AS (SELECT * FROM boxes x WHERE NOT EXISTS (SELECT 1 FROM lines y WHERE y.category='BUBBLED' AND y.page_id=x.page_id AND {COVER})),
emp AS (SELECT page_id, count(*) AS empty_bubbles_with_ink FROM bare g WHERE EXISTS (SELECT 1 FROM open_boxes x WHERE x.page_id=g.page_id AND ({holds('g','x')} OR ({inter('x','g')}>0 AND {inter('x','g')}*100>=45*{area('x')}))) GROUP BY page_id),
pg AS (SELECT page_id FROM boxes UNION SELECT page_id FROM lines UNION SELECT page_id FROM regions),
bc AS (SELECT page_id, count(*) AS m1_box_count, count(*) FILTER (WHERE category='BUBBLED') AS m1_5_bubbled, count(*) FILTER (WHERE category='ORPHAN') AS m1_5_orphan, count(*) FILTER (WHERE category='SFX') AS m1_5_sfx FROM boxes GROUP BY page_id),
lc AS (SELECT page_id, count(*) AS m2_lines_total, count(*) FILTER (WHERE category='BUBBLED') AS m2_bubbled_lines, count(*) FILTER (WHERE category='ORPHAN') AS m2_orphan_lines, count(*) FILTER (WHERE category='SFX') AS m2_sfx_lines FROM lines GROUP BY page_id),
gc AS (SELECT page_id, count(*) AS bubble_count FROM regions GROUP BY page_id),
led AS (SELECT page_id, coalesce(cw,26) AS global_char_w, coalesce(m1_box_count,0) AS m1_box_count, coalesce(bubble_count,0) AS bubble_count, coalesce(m1_5_bubbled,0) AS m1_5_bubbled, coalesce(m1_5_orphan,0) AS m1_5_orphan, coalesce(m1_5_sfx,0) AS m1_5_sfx,
 coalesce(m2_lines_total,0) AS m2_lines_total, coalesce(m2_bubbled_lines,0) AS m2_bubbled_lines, coalesce(m2_orphan_lines,0) AS m2_orphan_lines, coalesce(m2_sfx_lines,0) AS m2_sfx_lines,
 coalesce(column_fragmentations,0) AS column_fragmentations, coalesce(column_pitch_violations,0) AS column_pitch_violations, coalesce(gutter_crossover_count,0) AS gutter_crossover_count,
 coalesce(width_choking_count,0) AS width_choking_count, coalesce(boundary_bleed_count,0) AS boundary_bleed_count, coalesce(boundary_bleed_area,0) AS boundary_bleed_area, coalesce(furigana_leaks,0) AS furigana_leaks,
 coalesce(m3_conjoined_bubbles,0) AS m3_conjoined_bubbles, coalesce(m3_split_lines,0) AS m3_split_lines, coalesce(waist_snap_failures,0) AS waist_snap_failures, coalesce(dropped_box_count,0) AS dropped_box_count, coalesce(empty_bubbles_with_ink,0) AS empty_bubbles_with_ink
 FROM pg LEFT JOIN pw USING (page_id) LEFT JOIN bc USING (page_id) LEFT JOIN lc USING (page_id) LEFT JOIN gc USING (page_id) LEFT JOIN frag USING (page_id) LEFT JOIN pit USING (page_id) LEFT JOIN cho USING (page_id) LEFT JOIN rub USING (page_id) LEFT JOIN sna USING (page_id) LEFT JOIN lost USING (page_id) LEFT JOIN emp USING (page_id)),
ledger AS (SELECT *, column_fragmentations+column_pitch_violations+width_choking_count+boundary_bleed_count+gutter_crossover_count+waist_snap_failures+dropped_box_count+empty_bubbles_with_ink AS total_violations FROM led)"""


def ledger(t):
    return A.page_ledger(t.boxes, t.lines, t.regions, parts(t))


@query("audit_page_ledger", uses="boxes lines regions", also=LEDGER, sql="SELECT * FROM ledger")
def _(t):
    return ledger(t)


@query("ledger_summary", uses="boxes lines regions", also=LEDGER + ",\nm(metric, bad) AS (VALUES " + ",".join(f"('{m}',{'NULL' if b is None else repr(b)})" for m, b in A.SUMMARY_METRICS) + "),\ntot AS (SELECT count(*) AS n, " + ",".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m, _ in A.SUMMARY_METRICS) + " FROM ledger),\nlong AS (UNPIVOT tot ON " + ",".join(m for m, _ in A.SUMMARY_METRICS) + " INTO NAME metric VALUE total)", sql="""
SELECT metric, total, round(total/n,2) AS rate_per_page, CASE WHEN bad IS NOT NULL THEN CASE WHEN total=0 THEN 'PASS' ELSE bad END END AS verdict FROM long JOIN m USING (metric)""")
def _(t):
    return A.ledger_summary(ledger(t))


@query("ledger_by_batch", uses="boxes lines regions", also=LEDGER, sql="""
SELECT 'batch_'||CAST(page_id%4+1 AS VARCHAR) AS batch, count(*) AS pages, CAST(sum(bubble_count) AS BIGINT) AS bubble_count, CAST(sum(m2_bubbled_lines) AS BIGINT) AS m2_bubbled_lines, CAST(sum(m2_orphan_lines) AS BIGINT) AS m2_orphan_lines, CAST(sum(m2_sfx_lines) AS BIGINT) AS m2_sfx_lines,
 CAST(sum(m3_conjoined_bubbles) AS BIGINT) AS m3_conjoined_bubbles, CAST(sum(total_violations) AS BIGINT) AS total_violations, round(avg(100+page_id*37%900),6) AS avg_ms FROM ledger GROUP BY 1""")
def _(t):
    d = ledger(t).withColumns({"batch": F.expr("concat('batch_', page_id % 4 + 1)"), "elapsed_ms": F.expr("100 + page_id * 37 % 900")})
    return A.ledger_by_batch(d).withColumn("avg_ms", F.round("avg_ms", 6))


STAGES = ["detect_ms", "group_ms", "render_ms"]


@query("latency_breakdown", uses="stage_times", also="s AS (SELECT avg(detect_ms) AS detect_ms, avg(group_ms) AS group_ms, avg(render_ms) AS render_ms, avg(detect_ms+group_ms+render_ms) AS total, avg(detect_ms+group_ms+render_ms) AS whole FROM stage_times),\nu AS (UNPIVOT s ON detect_ms, group_ms, render_ms, total INTO NAME stage VALUE a)", sql="""
SELECT stage, round(a,4) AS avg_ms, round(a*100/greatest(1.0,whole),4) AS pct_of_total FROM u""")
def _(t):
    return A.latency_breakdown(t.stage_times, STAGES)


@query("latency_breakdown_run", uses="lines", sql="""
SELECT count(*) AS pages, count(*) FILTER (WHERE o>0) AS pages_with_outside, round(count(*) FILTER (WHERE o>0)*100/count(*),4) AS pct_with_outside, round(count(*)/(2249.0::DOUBLE/60.0),4) AS pages_per_minute FROM (SELECT page_id, count(*) FILTER (WHERE category='ORPHAN' AND r-l>38) AS o FROM lines GROUP BY page_id)""")
def _(t):
    a = t.lines.groupBy("page_id").agg(F.count_if(F.expr("category = 'ORPHAN' AND r - l > 38")).alias("orphan_lines"))
    return A.run_totals(a, 2249.0)


METHODS = ["baseline", "median", "telea", "hybrid"]
TRIALS = """trials AS (SELECT o_orderkey AS page_id, (o_orderkey*7+o_custkey)%40 AS bg_std, 180+o_custkey%76 AS bg_mean, (o_orderkey*3)%31 AS baseline_std, (o_custkey*5)%29 AS median_std, (o_orderkey+o_custkey)%33 AS telea_std, (o_orderkey*11)%27 AS hybrid_std,
 o_custkey%19 AS baseline_ms, o_orderkey%13 AS median_ms, o_custkey%47 AS telea_ms, o_orderkey%17 AS hybrid_ms FROM orders)"""


@query("compare_methods", also=TRIALS + """,
w AS (SELECT *, CASE WHEN bg_std<16 OR bg_mean>235 THEN 'flat' ELSE 'line_art' END AS regime, least(baseline_std,median_std,telea_std,hybrid_std) AS m FROM trials),
x AS (""" + " UNION ALL ".join(f"SELECT regime, '{m}' AS method, {m}_std AS s, {m}_ms AS ms, ({m}_std=m{''.join(f' AND {p}_std<>m' for p in METHODS[:i])}) AS win FROM w" for i, m in enumerate(METHODS)) + ")", sql="""
SELECT regime, method, count(*) AS pages, round(avg(s),4) AS avg_std, round(avg(ms),4) AS avg_ms, count(*) FILTER (WHERE win) AS wins FROM x GROUP BY ALL""")
def _(t):
    return A.compare_methods(t._spark.sql("WITH " + TRIALS.replace("FROM orders", "FROM {orders}") + " SELECT * FROM trials", orders=t.orders), METHODS)


@query("extraction_summary", uses="zones", sql="""
SELECT 'batch_'||CAST(p_partkey%4+1 AS VARCHAR) AS batch, count(*) AS scanned, count(n) AS kept, count(*)-count(n) AS filtered, CAST(coalesce(sum(n),0) AS BIGINT) AS crops FROM part LEFT JOIN (SELECT page_id, count(*) AS n FROM zones GROUP BY page_id) ON page_id=p_partkey GROUP BY 1""")
def _(t):
    return A.extraction_summary(t.part.select(F.col("p_partkey").alias("page_id"), F.expr("concat('batch_', p_partkey % 4 + 1)").alias("batch")), t.zones)


@query("job_audit", uses="boxes lines regions", also=LEDGER, sql="""
(SELECT page_id, total_violations AS violations, 'worst' AS kind FROM ledger WHERE total_violations>0 ORDER BY total_violations DESC, page_id LIMIT 5) UNION ALL (SELECT page_id, total_violations, 'clean' FROM ledger WHERE total_violations=0 ORDER BY page_id LIMIT 5)""")
def _(t):
    return O.worst_pages(ledger(t).select("page_id", F.col("total_violations").alias("violations")))
