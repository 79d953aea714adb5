from pyspark.sql import functions as F

from checks.c_joins import LISTING, listing, plain
from checks.registry import query
from checks.sqlgeo import *
from pagelattice.operators import joins as J, ordering as O


def _order(name, band, rtl):
    @query(name, uses="boxes", sql=f"SELECT page_id, box_id, row_number() OVER (PARTITION BY page_id ORDER BY {cy('x')}//{band}, {'-' if rtl else ''}{cx('x')}, box_id) AS reading_order FROM boxes x")
    def _(t):
        return O.reading_order(plain(t), band, rtl).select("page_id", "box_id", "reading_order")


_order("reading_order", 200, True)
_order("reading_order_ltr", 200, False)
_order("reading_order_groups", 250, True)


@query("reading_order_crops", uses="regions", sql="SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY t//150, -l, region_id) AS reading_order FROM regions")
def _(t):
    return O.corner_order(t.regions, 150, "region_id").select("page_id", "region_id", "reading_order")


@query("reading_order_blocks", uses="regions", sql="SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY t//180, -l, region_id) AS reading_order FROM regions")
def _(t):
    return O.corner_order(t.regions, 180, "region_id").select("page_id", "region_id", "reading_order")


@query("reading_order_strips", uses="lines", sql="SELECT page_id, line_id, row_number() OVER (PARTITION BY page_id ORDER BY -(r//35), t, line_id) AS reading_order FROM lines")
def _(t):
    return O.strip_order(t.lines, 35, "line_id").select("page_id", "line_id", "reading_order")


@query("in_group_order", uses="lines", sql=f"SELECT page_id, line_id, row_number() OVER (PARTITION BY page_id, category ORDER BY -{cx('x')}, t, line_id) AS line_order FROM lines x")
def _(t):
    return O.in_group_order(t.lines, ["page_id", "category"], "line_id").select("page_id", "line_id", "line_order")


@query("crop_ids", uses="manifest", sql="""
SELECT bubble_id, row_number() OVER (PARTITION BY batch ORDER BY page_name, t//150, -l, crop_key) AS seq_no, row_number() OVER (PARTITION BY batch, page_name ORDER BY t//150, -l, crop_key) AS index_on_page,
 batch||'_b'||lpad(CAST(row_number() OVER (PARTITION BY batch ORDER BY page_name, t//150, -l, crop_key) AS VARCHAR),5,'0') AS new_id FROM manifest""")
def _(t):
    return O.crop_ids(t.manifest).select("bubble_id", "seq_no", "index_on_page", "new_id")


@query("queue_navigation", uses="manifest", sql="""
SELECT bubble_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY batch) AS total, lag(bubble_id) OVER w AS previous_id, lead(bubble_id) OVER w AS next_id FROM manifest WHERE NOT is_discarded WINDOW w AS (PARTITION BY batch ORDER BY crop_key)""")
def _(t):
    return O.queue_navigation(t.manifest.where("NOT is_discarded").select("batch", "crop_key", "bubble_id")).drop("batch", "crop_key")


@query("line_chunks", uses="dialogue", also="d AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY line_no)-1)//2 AS chunk_no FROM dialogue)", sql="""
SELECT page_id, chunk_no, count(*) AS n_lines, min(line_no*7) AS l, min(line_no*31) AS t, max(line_no*7+20) AS r, max(line_no*31+length(text)%97) AS b, string_agg(text,'' ORDER BY line_no) AS text FROM d GROUP BY ALL""")
def _(t):
    d = t.dialogue.withColumns({"l": F.col("line_no") * 7, "t": F.col("line_no") * 31, "r": F.col("line_no") * 7 + 20, "b": F.col("line_no") * 31 + F.length("text") % 97})
    return O.line_chunks(d, 2)


@query("carry_forward", uses="stage_times", sql="""
SELECT page_id, seq, last_value(CASE WHEN group_ms>0 THEN group_ms END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS group_ms_eff FROM stage_times""")
def _(t):
    return O.carry_forward(t.stage_times.select("page_id", "seq", "group_ms"), ["page_id"], "seq", "group_ms", "group_ms_eff").drop("group_ms")


@query("usage_deltas", uses="logs", also="d AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))", sql="""
SELECT event_id, round(CASE WHEN epoch_us(ts)>epoch_us(pt) THEN greatest(0.0,least(100.0,(value-pv)*1e8/((epoch_us(ts)-epoch_us(pt))*4))) END,9) AS usage_pct FROM d""")
def _(t):
    return O.usage_deltas(t.logs.select("event_id", "user_id", "ts", "value"), "user_id", 4).select("event_id", F.round("usage_pct", 9).alias("usage_pct"))


LEDGER = f"""page_ledger AS (SELECT page_id, 'batch_'||CAST(page_id%4+1 AS VARCHAR) AS batch, count(*) AS n_lines, CAST(sum(CASE WHEN r-l<9 AND t<40 THEN 1 ELSE 0 END) AS BIGINT) AS violations, CAST(sum({area('x')}) AS BIGINT) AS erased FROM lines x GROUP BY page_id)"""


def page_ledger(t):
    return t.lines.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.expr("r - l < 9 AND t < 40")).alias("violations"),
                                          F.sum(F.expr("(r - l) * (b - t)")).alias("erased")).withColumn("batch", F.expr("concat('batch_', page_id % 4 + 1)"))


@query("topk_worst_pages", uses="lines", also=LEDGER, sql="""
(SELECT *, 'worst' AS kind FROM page_ledger WHERE violations>0 ORDER BY violations DESC, page_id LIMIT 5) UNION ALL (SELECT *, 'clean' AS kind FROM page_ledger WHERE violations=0 ORDER BY page_id LIMIT 5)""")
def _(t):
    return O.worst_pages(page_ledger(t))


@query("topk_per_batch", uses="lines", also=LEDGER, sql="SELECT *, row_number() OVER (PARTITION BY batch ORDER BY erased DESC, page_id) AS place FROM page_ledger QUALIFY place<=6")
def _(t):
    return O.top_pages_per_batch(page_ledger(t), "erased", 6)


@query("first_k_matching", uses="lines", sql="""
SELECT 'batch_'||CAST(page_id%4+1 AS VARCHAR) AS batch, page_id, row_number() OVER (PARTITION BY page_id%4 ORDER BY page_id) AS place, count(*) AS n_lines,
 greatest(0,min(l)-20) AS crop_l, greatest(0,min(t)-20) AS crop_t, least(512,max(r)+20) AS crop_r, least(800,max(b)+20) AS crop_b
FROM lines WHERE category='ORPHAN' AND b-t>=60 AND r-l>=14 GROUP BY page_id QUALIFY place<=3""")
def _(t):
    return O.first_matching_pages(t.lines.withColumn("batch", F.expr("concat('batch_', page_id % 4 + 1)")))


@query("queue_head", uses="manifest", sql="""
SELECT batch, arg_min(bubble_id, crop_key) FILTER (WHERE status='unlabeled' AND NOT is_discarded) AS next_unlabeled, min(bubble_id) FILTER (WHERE status IN ('conjoined','recheck') AND NOT is_discarded) AS next_review,
 count(*) FILTER (WHERE status IN ('conjoined','recheck') AND NOT is_discarded) AS pending FROM manifest GROUP BY batch""")
def _(t):
    return O.queue_head(t.manifest)


@query("natural_sort", uses="files", also="k AS (SELECT file_id, path, regexp_extract(path,'^https?://[^/]+') AS host, CAST(coalesce(nullif(regexp_extract(path,'/[a-z]+/(\\d+)',1),''),'-1') AS INT) AS num, regexp_extract(path,'/([a-z]+)/\\d+',1) AS lang, regexp_extract(path,'/[a-z]+/\\d+(.*)$',1) AS rest FROM files)", sql="""
SELECT file_id, row_number() OVER (PARTITION BY host ORDER BY lang, num, CASE WHEN rest LIKE '?page=%' THEN '?page=' ELSE lower(rest) END, CAST(coalesce(nullif(regexp_extract(rest,'page=(\\d+)',1),''),'0') AS INT), path) AS position FROM k""")
def _(t):
    return O.natural_sort(t.files.withColumn("host", F.regexp_extract("path", r"^https?://[^/]+", 0)), ["host"]).select("file_id", "position")


@query("featured_first", also=LISTING, sql="SELECT series, min(list_no) AS list_no, arg_min(filename, list_no) AS filename FROM listing GROUP BY series")
def _(t):
    return O.featured_first(listing(t)).select("series", "list_no", "filename")


@query("error_gallery", uses="manifest points", also="""e AS (SELECT crop_key, conf_conj_m, conf_single_m, CASE WHEN conf_conj_m>=conf_single_m AND NOT is_conjoined THEN 'false_positive' WHEN conf_conj_m<conf_single_m AND is_conjoined THEN 'false_negative' END AS kind
 FROM manifest JOIN points USING (crop_key) WHERE (status='verified' OR is_conjoined IS NOT NULL) AND NOT is_discarded)""", sql="""
SELECT *, (row_number() OVER w-1)//7 AS gallery_row, (row_number() OVER w-1)%7 AS gallery_col FROM e WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY kind ORDER BY crop_key)""")
def _(t):
    from pagelattice.operators.filters import eval_ready
    d = eval_ready(t.manifest).select("crop_key", "is_conjoined").join(t.points.select("crop_key", "conf_conj_m", "conf_single_m"), "crop_key")
    d = d.withColumn("predicted", F.col("conf_conj_m") >= F.col("conf_single_m"))
    return O.error_gallery(d).select("crop_key", "conf_conj_m", "conf_single_m", "kind", "gallery_row", "gallery_col")
