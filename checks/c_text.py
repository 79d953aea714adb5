import string

from pyspark.sql import functions as F

from checks.registry import query
from pagelattice.functions import text as X
from pagelattice.operators import translation as M

DOC_LINES = """dl AS (SELECT doc_id, i AS line_no, s FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), LATERAL (SELECT unnest(a) AS s, generate_subscripts(a,1) AS i))"""


@query("txt_compose", also=DOC_LINES + r""",
kept AS (SELECT doc_id, line_no, regexp_replace(s,'^\s+|\s+$','','g') AS s FROM dl WHERE regexp_replace(s,'^\s+|\s+$','','g')<>''),
prev AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM kept)""", sql=r"""
SELECT doc_id, coalesce(string_agg(CASE WHEN p IS NULL OR right(p,1) IN ('-','—','・') THEN s ELSE ' '||s END, '' ORDER BY line_no),'') AS text
FROM documents LEFT JOIN prev USING (doc_id) GROUP BY doc_id""")
def _(t):
    return t.documents.select("doc_id", X.compose(F.split("text", "\n")).alias("text"))


@query("txt_join_nospace", also=DOC_LINES, sql=r"""
SELECT doc_id, coalesce(string_agg(regexp_replace(s,'^\s+|\s+$','','g'), '' ORDER BY line_no),'') AS text FROM dl GROUP BY doc_id""")
def _(t):
    return t.documents.select("doc_id", X.join_tight(F.split("text", "\n")).alias("text"))


def _collapse(expr):
    for c in string.ascii_letters:
        expr = f"regexp_replace({expr},'{c}{{3,}}','{c}{c}','g')"
    return expr


_PUNCT = "replace(replace(replace(replace(replace(replace({},'！','!'),'？','?'),'…','...'),'‥','..'),'～','〜'),'　',' ')"


@query("txt_normalize_source", sql="SELECT doc_id, regexp_replace(" + _PUNCT.format(
    "regexp_replace(" + _collapse(r"regexp_replace(replace(text,chr(10),' '),'^\s+|\s+$','','g')") + r",'(\S)([♡♥〜～♪])','\1 \2','g')")
    + r",'^\s+|\s+$','','g') AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", X.normalize_source(F.col("text")).alias("text"))


@query("txt_clean_target", sql=r"""
SELECT page_id, line_no, CASE WHEN regexp_replace(text,'\s','','g')='' THEN text ELSE regexp_replace(regexp_replace(regexp_replace(upper(left(text,1))||substr(text,2),'\s+([!?,.:;])','\1','g'),'\s+',' ','g'),'^\s+|\s+$','','g') END AS text
FROM (SELECT conv_id AS page_id, turn AS line_no, '  '||lower(replace(text,'.',' .')) AS text FROM conversations UNION ALL SELECT doc_id, -1, lower(text) FROM documents)""")
def _(t):
    a = t.dialogue.select("page_id", "line_no", F.concat(F.lit("  "), F.lower(F.replace("text", F.lit("."), F.lit(" .")))).alias("text"))
    b = t.documents.select(F.col("doc_id").alias("page_id"), F.lit(-1).cast("long").alias("line_no"), F.lower("text").alias("text"))
    return a.unionByName(b).withColumn("text", X.clean_target(F.col("text")))


ARCHIVES = """archives AS (SELECT p_partkey AS file_id, 'downloads/' || CASE p_size%5 WHEN 0 THEN '[Anthology] ' ELSE '' END || p_name || CASE p_size%3 WHEN 0 THEN ' Ch. '||CAST(p_size AS VARCHAR) ELSE '' END || '/' ||
 CASE p_size%4 WHEN 0 THEN 'Chapter.cbz' WHEN 1 THEN 'chapter '||CAST(p_size AS VARCHAR)||'.cbz' ELSE replace(p_brand,'#',' "')||' '||p_type||'.cbz' END AS path FROM part)"""


def archives(t):
    return t._spark.sql("WITH " + ARCHIVES.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}") + " SELECT * FROM archives", part=t.part)


@query("txt_title_clean", also=ARCHIVES, sql="SELECT file_id, trim(replace(replace(split_part(path,'/',2),'[Anthology]',''),'Chapter.cbz','')) AS title FROM archives")
def _(t):
    return archives(t).select("file_id", X.title_from_path(F.col("path")).alias("title"))


@query("txt_safe_name", also=ARCHIVES + ", names AS (SELECT file_id, path AS s FROM archives UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT doc_id, text FROM documents), n1 AS (SELECT file_id, trim(regexp_replace(regexp_replace(replace(s,'\"',''''),'[/\\\\:*?<>|]','-','g'),'\\s+',' ','g'),' .-') AS s FROM names)",
       sql="SELECT file_id, CASE WHEN trim(x)='' THEN 'Translated Manga' ELSE x END AS name FROM (SELECT file_id, CASE WHEN length(s)>180 THEN trim(left(s,180),' .-') ELSE s END AS x FROM n1)")
def _(t):
    s = archives(t).select("file_id", F.col("path").alias("s")).unionByName(t.pages.select(F.col("page_id").alias("file_id"), F.col("url").alias("s"))) \
        .unionByName(t.documents.select(F.col("doc_id").alias("file_id"), F.col("text").alias("s")))
    return s.select("file_id", X.safe_name(F.col("s")).alias("name"))


@query("txt_chapter_name", also=ARCHIVES + r""",
p AS (SELECT file_id, regexp_replace(split_part(path,'/',3),'\.[^.]*$','') AS f, split_part(path,'/',2) AS d FROM archives)""", sql=r"""
SELECT file_id, CASE WHEN regexp_matches(f,'(?i)(chapter|ch\.?)\s*\d+') OR lower(f)<>'chapter' THEN f
 WHEN regexp_matches(d,'(?i)(chapter|ch\.?)\s*\d+') THEN 'Chapter '||regexp_extract(d,'(?i)(?:chapter|ch\.?)\s*(\d+)',1) ELSE d END || ' Translated.cbz' AS name FROM p""")
def _(t):
    return archives(t).select("file_id", X.chapter_name(F.col("path")).alias("name"))


KEY_SQL = r"""array_to_string(list_transform(regexp_extract_all(path,'\d+|\D+'), lambda x: CASE WHEN regexp_full_match(x,'\d+') THEN lpad(CAST(length(ltrim(x,'0'))+CASE WHEN ltrim(x,'0')='' THEN 1 ELSE 0 END AS VARCHAR),5,'0')||CASE WHEN ltrim(x,'0')='' THEN '0' ELSE ltrim(x,'0') END ELSE lower(x) END), chr(1))"""


@query("txt_natural_key", uses="files", sql=f"SELECT file_id, {KEY_SQL} AS nkey FROM files")
def _(t):
    return t.files.select("file_id", X.natural_key(F.col("path")).alias("nkey"))


@query("txt_parse_keys", uses="manifest", sql="""
SELECT bubble_id, split_part(page_name,'_',1) AS chapter, regexp_extract(split_part(page_name,'_',2),'p\\d+') AS page,
 batch||'_'||crop_key AS stem FROM manifest""")
def _(t):
    file_name = F.concat("batch", F.lit("_"), F.col("crop_key").cast("string"), F.lit("_crop.png"))
    return t.manifest.select("bubble_id", X.chapter_key(F.col("page_name")).alias("chapter"), X.page_key(F.col("page_name")).alias("page"),
                             X.crop_key(file_name).alias("stem"))


@query("mt_requests", uses="dialogue", sql="""
SELECT page_id, CAST(0 AS BIGINT) AS request_no, count(*) AS n_blocks, CAST(to_json(list(text ORDER BY line_no)) AS VARCHAR) AS request FROM dialogue
WHERE regexp_replace(text,'\\s','','g')<>'' GROUP BY page_id""")
def _(t):
    return M.requests(t.dialogue)


@query("mt_requests_numbered", uses="dialogue", sql="""
SELECT page_id, CAST(0 AS BIGINT) AS request_no, count(*) AS n_blocks, string_agg('['||k||'] '||text, chr(10) ORDER BY line_no) AS request
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS k FROM dialogue) GROUP BY page_id""")
def _(t):
    return M.requests(t.dialogue, style="numbered")


def _replies(t, style):
    """Stand-in for a translator: marked lines, every third one blank or without number."""
    d = t.dialogue.withColumn("x", F.concat(F.lit("T "), F.regexp_replace("text", r"\s+", " ")))
    if style == "json":
        v = F.when(F.col("line_no") % 3 == 2, "").otherwise(F.col("x"))
        body = F.to_json(F.concat(F.transform(F.array_sort(F.collect_list(F.struct("line_no", v.alias("v")))), lambda i: i["v"]), F.array(F.lit("SURPLUS"))))
    else:
        v = F.when(F.col("line_no") % 3 == 2, F.col("x")).otherwise(F.concat(F.lit("["), (F.col("line_no") + 1).cast("string"), F.lit("] "), F.col("x")))
        body = F.concat(F.lit("<think>[1] no\nyet</think>\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", v.alias("v")))), lambda i: i["v"]), "\n"))
    return d.groupBy("page_id").agg(body.alias("reply")).withColumn("request_no", F.lit(0).cast("long"))


@query("mt_attach_positional", uses="dialogue", sql=r"""
SELECT page_id, line_no, role, text, CASE WHEN line_no%3<>2 THEN 'T '||regexp_replace(text,'\s+',' ','g') END AS translation FROM dialogue WHERE regexp_replace(text,'\s','','g')<>''""")
def _(t):
    return M.attach_positional(t.dialogue, _replies(t, "json"))


@query("mt_attach_numbered", uses="dialogue", sql=r"""
SELECT page_id, line_no, role, text, trim('T '||regexp_replace(text,'\s+',' ','g')) AS translation FROM dialogue""")
def _(t):
    return M.attach_numbered(t.dialogue, _replies(t, "numbered"))


def _shout(texts):
    if any("!" in s for s in texts):
        raise ValueError("can not shout louder")
    return ["T " + s for s in texts]


@query("mt_batch_apply", uses="dialogue", sql=r"""
SELECT page_id, line_no, role, text, CASE WHEN regexp_replace(text,'\s','','g')='' THEN '' WHEN contains(text,'!') THEN text ELSE 'T '||text END AS translation FROM dialogue""")
def _(t):
    return M.batch_apply(t.dialogue, _shout)


@query("mt_batch_apply_progress", uses="dialogue", sql=r"""
SELECT count(*) AS total, count(*) FILTER (WHERE regexp_replace(text,'\s','','g')<>'') AS translated, count(*) FILTER (WHERE regexp_replace(text,'\s','','g')='') AS blank FROM dialogue""")
def _(t):
    return M.apply_progress(M.batch_apply(t.dialogue, _shout))
