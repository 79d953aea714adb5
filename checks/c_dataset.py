from pyspark.sql import functions as F

from checks.c_joins import sample_table, sync_source, SAMPLE
from checks.c_projections import AUGMENT
from checks.registry import query
from pagelattice.operators import annotations as AN, dataset as D, joins as J, ordering as O
from pagelattice.operators.filters import eval_ready
from pagelattice.session import scratch_path
from pagelattice.streaming.annotations import drained_state


@query("sample_per_batch", uses="manifest", sql="""
SELECT batch, bubble_id, row_number() OVER (PARTITION BY batch ORDER BY md5('1337:'||crop_key), crop_key) AS pick FROM manifest QUALIFY pick<=25""")
def _(t):
    return D.sample_per_batch(t.manifest.select("batch", "bubble_id", "crop_key"), 25, 1337, "crop_key").drop("crop_key")


@query("sample_global", uses="manifest", also="p AS (SELECT * FROM manifest ORDER BY md5('42:'||crop_key), crop_key LIMIT 1000)", sql="""
SELECT bubble_id AS original_id, row_number() OVER (ORDER BY page_name, t//150, -l, crop_key) AS seq_no, row_number() OVER (PARTITION BY page_name ORDER BY t//150, -l, crop_key) AS index_on_page,
 'sample_b'||lpad(CAST(row_number() OVER (ORDER BY page_name, t//150, -l, crop_key) AS VARCHAR),5,'0') AS new_id FROM p""")
def _(t):
    return D.sample_global(t.manifest, 1000, 42).select("original_id", "seq_no", "index_on_page", "new_id")


SPLIT = """ready AS (SELECT * FROM manifest WHERE is_conjoined IS NOT NULL AND NOT is_discarded),
placed AS (SELECT *, row_number() OVER (PARTITION BY is_conjoined ORDER BY md5('7:'||crop_key), crop_key) AS place, (SELECT count(*) FROM ready WHERE is_conjoined) AS pos FROM ready),
parted AS (SELECT *, CASE WHEN place<=CASE WHEN is_conjoined THEN 30 ELSE 100 END THEN 'val' WHEN is_conjoined OR place<=100+greatest(pos-30,0) THEN 'train' END AS split FROM placed)"""


def ready(t):
    return t.manifest.where("is_conjoined IS NOT NULL AND NOT is_discarded")


@query("split_stratified", uses="manifest", also=SPLIT, sql="SELECT bubble_id, is_conjoined, place, split FROM parted WHERE split IS NOT NULL")
def _(t):
    return D.split_stratified(ready(t), 7, 30, 100, 1).select("bubble_id", "is_conjoined", "place", "split")


def usable(t):
    """Three stand-in batches with differing columns: cut points, a dividing line, or neither."""
    d = t.manifest.join(t.points, "crop_key").select("batch", "bubble_id", "crop_key", "crop_w", "crop_h", "is_conjoined", "is_discarded", "x0", "y0", "x1", "y1")
    pts = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    none = F.array().cast("array<struct<x:int,y:int>>")
    base = d.drop("x0", "y0", "x1", "y1")
    a = d.where("batch IN ('batch_1', 'batch_2')").withColumn("cut_points", pts).select(*base.columns, "cut_points")
    b = d.where("batch IN ('batch_3', 'batch_4')").withColumns({"line_points": pts, "cut_points": none}).select(*base.columns, "cut_points", "line_points")
    c = d.where("batch = 'batch_5'").select(*base.columns)
    return [a, b, c]


UNION = """u AS (SELECT m.*, x0, y0, x1, y1 FROM manifest m JOIN points USING (crop_key) WHERE NOT is_discarded AND is_conjoined IS NOT NULL AND (NOT is_conjoined OR batch<>'batch_5')),
canon AS (SELECT *, (x1<x0 OR (x1=x0 AND y1<y0)) AS s FROM u),
unioned AS (SELECT batch, bubble_id, crop_key, crop_w, crop_h, is_conjoined, CASE WHEN is_conjoined THEN CASE WHEN s THEN x1 ELSE x0 END END AS x0, CASE WHEN is_conjoined THEN CASE WHEN s THEN y1 ELSE y0 END END AS y0,
 CASE WHEN is_conjoined THEN CASE WHEN s THEN x0 ELSE x1 END END AS x1, CASE WHEN is_conjoined THEN CASE WHEN s THEN y0 ELSE y1 END END AS y1 FROM canon)"""


@query("union_batches", uses="manifest points", also=UNION, sql="SELECT batch, bubble_id, is_conjoined, x0, y0, x1, y1 FROM unioned")
def _(t):
    return D.union_batches(usable(t)).select("batch", "bubble_id", "is_conjoined", "x0", "y0", "x1", "y1")


@query("dedup_paths", uses="files", also="l AS (SELECT 1 AS root_no, file_id, regexp_replace(path,'[?#].*$','') AS path FROM files UNION ALL SELECT 0, doc_id, regexp_replace(url,'[?#].*$','') FROM labels JOIN pages ON page_id=doc_id)", sql="""
SELECT path, root_no, file_id FROM l QUALIFY row_number() OVER (PARTITION BY path ORDER BY root_no, file_id)=1""")
def _(t):
    cut = lambda c: F.regexp_replace(c, r"[?#].*$", "").alias("path")
    a = t.files.select(F.lit(1).alias("root_no"), "file_id", cut("path"))
    b = t.labels.join(t.pages, F.col("doc_id") == F.col("page_id")).select(F.lit(0).alias("root_no"), F.col("doc_id").alias("file_id"), cut("url"))
    return D.dedup_paths(a.unionByName(b))


@query("set_diff_ids", sql="""
SELECT doc_id, 'unannotated' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT page_id, 'orphaned' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT doc_id, 'orphaned' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) AND doc_id NOT IN (SELECT page_id FROM pages)""")
def _(t):
    noted = t.labels.select("doc_id").unionByName(t.pages.join(t.documents, F.col("page_id") == F.col("doc_id"), "left_anti").select(F.col("page_id").alias("doc_id")))
    return D.id_differences(t.documents, noted, "doc_id")


LABEL = """'{c} 0.500000 0.500000 1.000000 1.000000 '||CASE WHEN {k} THEN printf('%.6f %.6f 2 %.6f %.6f 2', greatest(0.0,least(1.0,x0/{w})), greatest(0.0,least(1.0,y0/{h})), greatest(0.0,least(1.0,x1/{w})), greatest(0.0,least(1.0,y1/{h}))) ELSE '0.000000 0.000000 0 0.000000 0.000000 0' END"""


def label_sql(k, w, h):
    return LABEL.format(c="'||CASE WHEN " + k + " THEN '0' ELSE '1' END||'", k=k, w=w, h=h)


@query("sink_labels", uses="manifest points", also=UNION, sql=f"SELECT bubble_id, {label_sql('is_conjoined','crop_w','crop_h')} AS label FROM unioned")
def _(t):
    return D.to_pose_labels(D.union_batches(usable(t))).select("bubble_id", "label")


JOB = UNION + ",\n" + SPLIT.replace("ready AS (SELECT * FROM manifest WHERE is_conjoined IS NOT NULL AND NOT is_discarded)", "ready AS (SELECT * FROM unioned)") + ",\n" + AUGMENT.replace(
    "base AS (SELECT crop_key, x0,y0,x1,y1, crop_w, crop_h FROM points JOIN manifest USING (crop_key) WHERE is_conjoined AND NOT is_discarded)",
    "base AS (SELECT crop_key, x0,y0,x1,y1, crop_w, crop_h FROM parted WHERE split='train' AND is_conjoined)")


@query("job_dataset", uses="manifest points", also=JOB, sql=f"""
SELECT bubble_id, split, 'original' AS variant, {label_sql('is_conjoined','crop_w','crop_h')} AS label FROM parted WHERE split='val' OR (split='train' AND NOT is_conjoined)
UNION ALL SELECT p.bubble_id, 'train', a.variant, '0 0.500000 0.500000 1.000000 1.000000 '||printf('%.6f %.6f 2 %.6f %.6f 2', greatest(0.0,least(1.0,a.x0/out_w)), greatest(0.0,least(1.0,a.y0/out_h)), greatest(0.0,least(1.0,a.x1/out_w)), greatest(0.0,least(1.0,a.y1/out_h))) FROM augmented a JOIN parted p USING (crop_key)""")
def _(t):
    return D.training_labels(D.union_batches(usable(t)), 7, val_pos=30, val_neg=100, ratio=1)


@query("job_dataset_synced", uses="manifest points", also=SAMPLE, sql="""
SELECT is_conjoined, count(*) AS n, count(*) FILTER (WHERE synced) AS n_synced FROM merged WHERE NOT is_discarded AND is_conjoined IS NOT NULL GROUP BY is_conjoined""")
def _(t):
    m = J.label_sync(sync_source(t), sample_table(t))
    return m.where("NOT is_discarded AND is_conjoined IS NOT NULL").groupBy("is_conjoined").agg(F.count(F.lit(1)).alias("n"), F.count_if("synced").alias("n_synced"))


@query("agg_batch_status", uses="manifest", also="""
b AS (SELECT batch, count(*) AS total, count(*) FILTER (WHERE is_discarded) AS discarded, count(*) FILTER (WHERE NOT is_discarded AND status='unlabeled') AS unlabeled, count(*) FILTER (WHERE NOT is_discarded AND status IN ('verified','annotated')) AS verified,
 count(*) FILTER (WHERE NOT is_discarded AND status='conjoined') AS queued, count(*) FILTER (WHERE NOT is_discarded AND status='unverified') AS unverified, count(*) FILTER (WHERE NOT is_discarded AND status='recheck') AS recheck,
 count(*) FILTER (WHERE NOT is_discarded AND is_conjoined) AS conjoined, count(*) FILTER (WHERE NOT is_discarded AND NOT is_conjoined) AS single FROM manifest GROUP BY batch),
d AS (SELECT *, CASE WHEN batch='batch_2' THEN verified+discarded ELSE total-unlabeled END AS done FROM b),
al AS (SELECT * FROM d UNION ALL SELECT NULL, """ + ",".join(f"CAST(sum({c}) AS BIGINT)" for c in "total discarded unlabeled verified queued unverified recheck conjoined single done".split()) + " FROM d)", sql="SELECT *, round((verified+discarded)*100/total,1) AS pct_complete FROM al")
def _(t):
    return D.batch_status(t.manifest, "batch_2")


EVAL = "e AS (SELECT crop_key, is_conjoined, conf_conj_m>=conf_single_m AS predicted, x0,y0,x1,y1,px0,py0,px1,py1 FROM manifest JOIN points USING (crop_key) WHERE (status='verified' OR is_conjoined IS NOT NULL) AND NOT is_discarded)"


def evaluated(t):
    p = t.points.withColumn("predicted", F.col("conf_conj_m") >= F.col("conf_single_m")).drop("conf_conj_m", "conf_single_m")
    return eval_ready(t.manifest).select("crop_key", "is_conjoined", "crop_w", "crop_h").join(p, "crop_key", "left")


CONF = """c AS (SELECT count(*) FILTER (WHERE is_conjoined AND predicted) AS tp, count(*) FILTER (WHERE is_conjoined AND NOT predicted) AS fn, count(*) FILTER (WHERE NOT is_conjoined AND NOT predicted) AS tn, count(*) FILTER (WHERE NOT is_conjoined AND predicted) AS fp, count(*) AS eligible FROM e)"""
CONF_OUT = """SELECT tp, fn, tn, fp, eligible, round((tp+tn)*100/eligible,6) AS accuracy, round(tp*100/(tp+fp),6) AS "precision", round(tp*100/(tp+fn),6) AS recall, round(tn*100/(tn+fp),6) AS specificity, round(tp*200/(tp*2+fp+fn),6) AS f1 FROM c"""
RATES = ("accuracy", "precision", "recall", "specificity", "f1")


@query("agg_confusion", uses="manifest points", also=EVAL + "," + CONF, sql=CONF_OUT)
def _(t):
    return D.confusion(evaluated(t)).withColumns({c: F.round(c, 6) for c in RATES})


KP = EVAL + """,
k AS (SELECT *, (x1<x0 OR (x1=x0 AND y1<y0)) AS s FROM e WHERE is_conjoined),
g AS (SELECT CASE WHEN s THEN x1 ELSE x0 END AS ax, CASE WHEN s THEN y1 ELSE y0 END AS ay, CASE WHEN s THEN x0 ELSE x1 END AS bx, CASE WHEN s THEN y0 ELSE y1 END AS by_, px0,py0,px1,py1 FROM k),
r AS (SELECT 'raw' AS kind, sqrt((px0-ax)*(px0-ax)+(py0-ay)*(py0-ay)) AS err FROM g UNION ALL SELECT 'raw', sqrt((px1-bx)*(px1-bx)+(py1-by_)*(py1-by_)) FROM g
 UNION ALL SELECT 'snapped', sqrt(((px0//5)*5-ax)*((px0//5)*5-ax)+((py0//5)*5-ay)*((py0//5)*5-ay)) FROM g UNION ALL SELECT 'snapped', sqrt(((px1//5)*5-bx)*((px1//5)*5-bx)+((py1//5)*5-by_)*((py1//5)*5-by_)) FROM g)"""
KP_OUT = "SELECT kind, count(*) AS n, round(quantile_cont(err,0.5),6) AS median_err, round(avg(err),6) AS mean_err, round(avg(CASE WHEN err<=10 THEN 100.0 ELSE 0.0 END),6) AS within_10, round(avg(CASE WHEN err<=20 THEN 100.0 ELSE 0.0 END),6) AS within_20 FROM r GROUP BY kind"


def snapped(t):
    d = evaluated(t).where("is_conjoined")
    return d.withColumns({f"s{c}{i}": (F.floor(F.col(f"p{c}{i}") / 5) * 5).cast("int") for c in "xy" for i in (0, 1)})


@query("agg_keypoint_error", uses="manifest points", also=KP, sql=KP_OUT)
def _(t):
    return D.keypoint_error(snapped(t))


@query("agg_cut_arity", uses="manifest candidates", also="a AS (SELECT crop_key, count(*) AS np, count(*) FILTER (WHERE depth>30) AS nl FROM candidates GROUP BY crop_key)", sql="""
SELECT count(*) FILTER (WHERE nl>1 OR np>2) AS multi_cut, count(*) FILTER (WHERE NOT (nl>1 OR np>2)) AS single_cut FROM a""")
def _(t):
    # Stand-in annotation documents: all candidate points of a crop, its deep ones as lines.
    a = t.candidates.groupBy("crop_key").agg(F.collect_list("point_id").alias("points"), F.collect_list(F.when(F.col("depth") > 30, F.col("point_id"))).alias("lines"))
    return D.cut_arity(a)


@query("job_evaluate", uses="manifest points", also=KP + "," + CONF + ",\nconf AS (" + CONF_OUT + "),\nkpe AS (" + KP_OUT + ")", sql="""
SELECT metric, value FROM (UNPIVOT (SELECT accuracy, "precision", recall, specificity, f1 FROM conf) ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT kind||'_median', median_err FROM kpe UNION ALL SELECT kind||'_mean', mean_err FROM kpe UNION ALL SELECT kind||'_within_10', within_10 FROM kpe UNION ALL SELECT kind||'_within_20', within_20 FROM kpe""")
def _(t):
    from pagelattice.plans.jobs import evaluate
    return evaluate(evaluated(t), snapped(t))


ST = """a AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY seq) AS i FROM actions),
ids AS (SELECT batch, list(DISTINCT bubble_id ORDER BY bubble_id) AS names, max(i) AS n FROM a GROUP BY batch),
walk AS (SELECT batch, names, n, 0 AS i, list_transform(names, lambda x: {'status':'unlabeled','conj':CAST(NULL AS BOOLEAN),'disc':false}) AS st, CAST([] AS STRUCT(p BIGINT, old STRUCT(status VARCHAR, conj BOOLEAN, disc BOOLEAN))[]) AS stack FROM ids
 UNION ALL SELECT batch, names, n, i+1,
  CASE WHEN action='undo' THEN CASE WHEN len(stack)=0 THEN st ELSE list_transform(st, lambda x, j: CASE WHEN j=stack[-1].p THEN stack[-1].old ELSE x END) END
   ELSE list_transform(st, lambda x, j: CASE WHEN j<>p THEN x WHEN action='flag_conjoined' THEN {'status':'conjoined','conj':true,'disc':x.disc} WHEN action='annotate_single' THEN {'status':'verified','conj':false,'disc':x.disc}
    WHEN action='annotate_conjoined' THEN {'status':'verified','conj':true,'disc':x.disc} WHEN action='discard' THEN {'status':'discarded','conj':x.conj,'disc':true} WHEN action='verify' THEN {'status':'verified','conj':x.conj,'disc':x.disc} ELSE {'status':'recheck','conj':x.conj,'disc':x.disc} END) END,
  CASE WHEN action='undo' THEN CASE WHEN len(stack)=0 THEN stack ELSE stack[:-2] END WHEN action IN ('verify','reject') THEN stack ELSE list_append(stack, {'p':p,'old':st[p]}) END
 FROM (SELECT w.*, a.action, CAST(list_position(w.names, a.bubble_id) AS BIGINT) AS p FROM walk w JOIN a ON a.batch=w.batch AND a.i=w.i+1)),
fin AS (SELECT batch, unnest(names) AS bubble_id, unnest(st) AS s FROM walk WHERE i=n)"""


@query("st_annotation_state", uses="actions", also=ST, sql="""
SELECT batch, bubble_id, s.status AS status, s.conj AS is_conjoined, s.disc AS is_discarded FROM fin WHERE EXISTS (SELECT 1 FROM actions x WHERE x.batch=fin.batch AND x.bubble_id=fin.bubble_id AND x.action<>'undo')""")
def _(t):
    return AN.annotation_state(t.actions)


@query("st_annotation_stream", uses="actions", also=ST, sql="""
SELECT batch, bubble_id, s.status AS status, s.conj AS is_conjoined, s.disc AS is_discarded FROM fin WHERE EXISTS (SELECT 1 FROM actions x WHERE x.batch=fin.batch AND x.bubble_id=fin.bubble_id AND x.action<>'undo')""")
def _(t):
    """The log arrives in four files, a trigger each; state goes on from trigger to trigger."""
    source = scratch_path(t._spark, "actions")
    last = t.actions.agg(F.max("seq")).first()[0] or 0
    for k in range(4):
        part = t.actions.where((F.col("seq") * 4 >= last * k) & ((F.col("seq") * 4 < last * (k + 1)) | F.lit(k == 3)))
        part.select("batch", "bubble_id", "seq", "action").coalesce(1).write.mode("append").parquet(source)
    stream = t._spark.readStream.schema("batch string, bubble_id string, seq bigint, action string").option("maxFilesPerTrigger", 1).parquet(source)
    return drained_state(stream, scratch_path(t._spark, "states"))


@query("sink_labels_files", uses="manifest points", also=JOB, sql=f"""
SELECT bubble_id, split, 'original' AS variant, {label_sql('is_conjoined','crop_w','crop_h')} AS label FROM parted WHERE split='val' OR (split='train' AND NOT is_conjoined)
UNION ALL SELECT p.bubble_id, 'train', a.variant, '0 0.500000 0.500000 1.000000 1.000000 '||printf('%.6f %.6f 2 %.6f %.6f 2', greatest(0.0,least(1.0,a.x0/out_w)), greatest(0.0,least(1.0,a.y0/out_h)), greatest(0.0,least(1.0,a.x1/out_w)), greatest(0.0,least(1.0,a.y1/out_h))) FROM augmented a JOIN parted p USING (crop_key)""")
def _(t):
    """Written as label files by split and read back."""
    path = scratch_path(t._spark, "labels")
    D.write_pose_labels(D.training_labels(D.union_batches(usable(t)), 7, val_pos=30, val_neg=100, ratio=1), path)
    return D.read_pose_labels(t._spark, path)
