"""The registered queries: each runs operators over whole tables; SQL gives the same rows independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as fn
from leafmill.operators import attachments as att
from leafmill.operators import chunks, diagrams, manifest, markup, retrieval, tree, vectors
from leafmill.operators.common import assemble
from leafmill.plans import fixtures as fx
from leafmill.plans.fixtures import derived
from leafmill.plans.scratch import scratch, stored
from leafmill.sources import files
from leafmill.sources.files import load
from leafmill.streaming import jobs

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- search

_SCORED = f"""
v as ({fx.VECTORS}),
q as (select vec_id as query_id, root_id, embedding from v where vec_id % 50 = 0),
s as (select query_id, chunk_id, v.root_id, v.page_id, q.root_id as q_root,
  list_cosine_similarity(v.embedding::double[], q.embedding::double[]) as score from q, v)"""
_HITS = f"""{_SCORED},
h as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s where root_id = q_root) where rank <= 5),
m as ({fx.MANIFEST}),
t as (select query_id, rank, chunk_id, h.root_id, h.page_id, score, coalesce(m.title, 'x') as title, m.web_url, d.lang as heading_path, d.text from h
  left join (select page_id, title, web_url from m) m on m.page_id = h.page_id left join documents d on d.doc_id = h.page_id)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = derived(spark, sf_dir, fx.VECTORS)
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "root_id", "embedding"), v


@query(f"with {_SCORED} select query_id, chunk_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s) where rank <= 5")
def topk_cosine(spark, sf_dir):
    return vectors.search(*_sides(spark, sf_dir), k=5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"with {_SCORED} select query_id, chunk_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s where root_id = q_root) where rank <= 5")
def topk_scoped(spark, sf_dir):
    return vectors.search(*_sides(spark, sf_dir), k=5, scoped=True).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"with {_SCORED} select query_id, chunk_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s where score >= 0.2) where rank <= 5")
def topk_threshold(spark, sf_dir):
    return vectors.search(*_sides(spark, sf_dir), k=5, threshold=0.2).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(SQL["topk_cosine"])
def topk_cells(spark, sf_dir):
    """The hits of topk_cosine from vectors kept in cells, of which each query meets only those that can hold one."""
    q, v = _sides(spark, sf_dir)
    centres = vectors.cell_centres(v)
    held = stored(vectors.in_cells(v, centres), "cells")
    return vectors.search_cells(q, held, centres, k=5)[0].select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, v = _sides(spark, sf_dir)
    found = vectors.search(q, v, k=5, scoped=True).join(v.select("chunk_id", "page_id"), "chunk_id")
    pages = derived(spark, sf_dir, fx.MANIFEST).select("page_id", "title", "web_url")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("heading_path"), "text")
    named = found.join(pages.withColumn("root", F.lit(0)), "page_id", "left").join(docs, "page_id", "left")
    return q, named.withColumn("title", F.coalesce("title", F.lit("x")))


@query(f"with {_HITS} select query_id, '' || string_agg('--- Source ' || rank || ' ---' || chr(10) || coalesce('Page: ' || title || chr(10), '') || coalesce('Section: ' || heading_path || chr(10), '') || coalesce('URL: ' || web_url || chr(10), '') || coalesce(text, '') || chr(10) || chr(10), '' order by rank) as context from t group by query_id")
def rag_context(spark, sf_dir):
    return retrieval.rag_context(*_hits(spark, sf_dir))


@query(f"""with {_HITS} select query_id, true as success, 'LLM chat model is not configured. Showing top matching excerpts:' || chr(10) || chr(10) ||
  string_agg('• ' || title || coalesce(' › ' || heading_path, '') || chr(10) || case when length(text) > 500 then left(text, 500) || '...' else coalesce(text, '') end, chr(10) || chr(10) order by rank) as answer from t group by query_id""")
def retrieval_answer(spark, sf_dir):
    return retrieval.retrieval_answer(*_hits(spark, sf_dir))


@query(f"""with {_HITS} select query_id, count(*) as n, string_agg(coalesce(title, '') || '|' || coalesce(web_url, '') || '|' || case when length(text) > 300 then left(text, 300) || '...' else coalesce(text, '') end, '#' order by rank) as joined from t group by query_id""")
def sources(spark, sf_dir):
    s = retrieval.sources(_hits(spark, sf_dir)[1])
    line = F.transform("sources", lambda x: F.concat(F.coalesce(x["title"], F.lit("")), F.lit("|"), F.coalesce(x["web_url"], F.lit("")), F.lit("|"), x["excerpt"]))
    return s.select("query_id", F.size("sources").cast("long").alias("n"), F.array_join(line, "#").alias("joined"))


@query(f"""with m as ({fx.MANIFEST}), h as (select doc_id, cast(floor(doc_id / 50) as bigint) as root_id, doc_id as page_id, case when doc_id % 2 = 0 then ' ' else source end as title, case when doc_id % 3 = 0 then 0.25 end as score, case when doc_id % 4 <> 0 then 0.4 end as distance from documents)
  select h.page_id, case when trim(h.title) <> '' then h.title else m.title end as title, m.web_url, coalesce(score, case when distance is not null then greatest(0.0, 1 - distance) end)::double as score
  from h left join m on m.page_id = h.page_id and m.root_id = h.root_id""")
def hit_enrichment(spark, sf_dir):
    h = load(spark, sf_dir, "documents").selectExpr("cast(floor(doc_id / 50) as bigint) as root_id", "doc_id as page_id", "case when doc_id % 2 = 0 then ' ' else source end as title", "cast(null as string) as web_url", "cast(case when doc_id % 3 = 0 then 0.25 end as double) as score", "cast(case when doc_id % 4 <> 0 then 0.4 end as double) as distance")
    return retrieval.hits(h, derived(spark, sf_dir, fx.MANIFEST)).select("page_id", "title", "web_url", "score")


@query("select conv_id, turn, case when length(text) <= 4000 and regexp_matches(text, '\\S') and 12 * turn + 1 <= 50 and turn / 4.0 <= 1 then 'valid' else 'rejected' end as verdict from conversations where role = 'user'")
def validate_queries(spark, sf_dir):
    q = load(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", "text as query", "12 * turn + 1 as top_k", "cast(turn / 4 as double) as threshold")
    good, bad = retrieval.validate_queries(q)
    return good.select("conv_id", "turn", F.lit("valid").alias("verdict")).unionByName(bad.select("conv_id", "turn", F.lit("rejected").alias("verdict")))


@query()
def embed_hashing(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    out = vectors.embed_hashing(docs)
    return out.select("chunk_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("square"))


@query("select cast(doc_id as string) as chunk_id, length(text)::double as size, (length(text) - length(replace(text, 'e', '')))::double as es from documents")
def embed_user_function(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    out = vectors.embed(rows, lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return out.select("chunk_id", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("es"))


@query()
def lsh_candidates(spark, sf_dir):
    q, v = _sides(spark, sf_dir)
    return vectors.lsh_candidates(q, v, 0.9).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


_UPSERT = f"with v as ({fx.VECTORS}), a as (select chunk_id, root_id, 1 as batch from v where vec_id % 3 <> 0), b as (select chunk_id, root_id + 100 as root_id, 2 as batch from v where vec_id % 2 = 0)"


@query(f"{_UPSERT} select coalesce(b.chunk_id, a.chunk_id) as chunk_id, coalesce(b.root_id, a.root_id) as root_id, coalesce(b.batch, a.batch) as batch from a full join b on a.chunk_id = b.chunk_id")
def vector_upsert(spark, sf_dir):
    v = derived(spark, sf_dir, fx.VECTORS)
    a = v.where("vec_id % 3 <> 0").selectExpr("chunk_id", "root_id", "1 as batch")
    return vectors.upsert_vectors(v.where("vec_id % 2 = 0").selectExpr("chunk_id", "root_id + 100 as root_id", "2 as batch"), a)


@query(f"with v as ({fx.VECTORS}) select chunk_id as id, 't' || chunk_id as text, case when vec_id % 2 = 0 then 'own' else 'meta' end as title, root_id from v")
def vector_documents(spark, sf_dir):
    v = derived(spark, sf_dir, fx.VECTORS).selectExpr("chunk_id", "concat('t', chunk_id) as text", "'own' as title", "root_id", "named_struct('title', case when vec_id % 2 = 1 then 'meta' end) as metadata")
    return vectors.vector_documents(v)


# ---------------------------------------------------------------- chunks

_SECTIONS = f"""
d as ({fx.MARKDOWN}),
l as (select page_id, unnest(string_split(md, chr(10))) as line, unnest(range(len(string_split(md, chr(10))))) as pos from d),
k as (select *, regexp_matches(line, '^#{{1,6}}[ \\t]+[^ \\t].*$') as is_head, case when regexp_matches(line, '^#{{1,6}}[ \\t]+.+$') then length(regexp_extract(line, '^(#+)', 1)) end as level, regexp_replace(line, '^#+[ \\t]+', '') as title from l),
n as (select *, sum(case when is_head then 1 else 0 end) over (partition by page_id order by pos) as section from k),
p as (select page_id, section, max(case when is_head and level = 1 then title end) as h1, max(case when is_head and level = 2 then title end) as h2, max(case when is_head and level = 3 then title end) as h3, max(case when is_head then level end) as level from n group by page_id, section),
r as (select page_id, section, level, last_value(h1 ignore nulls) over w as t1, last_value(h2 ignore nulls) over w as t2, h3 as t3 from p window w as (partition by page_id order by section rows between unbounded preceding and current row)),
b as (select page_id, section, regexp_replace(string_agg(line, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as body from n where not is_head group by page_id, section)"""
_PATHS = "array_to_string(list_filter([t1, case when level >= 2 or level is null then t2 end, case when level >= 3 then t3 end], lambda x: x is not null), ' > ')"


@query(f"with {_SECTIONS} select b.page_id, b.section::bigint as section, {_PATHS} as heading_path, body from b join r on b.page_id = r.page_id and b.section = r.section where body <> ''")
def chunk_sections(spark, sf_dir):
    return chunks.sections(derived(spark, sf_dir, fx.MARKDOWN)).select("page_id", "section", "heading_path", "body")


_PARTS = f"""recursive {_SECTIONS},
q as (select page_id, section, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ps, body from b where body <> ''),
f as (select page_id, section, 1 as i, [] :: varchar[] as parts, '' as open from q where length(body) > 4000
  union all
  select f.page_id, f.section, i + 1,
    case when open <> '' and length(open) + 2 + length(ps[i]) <= 4000 then parts
      when length(ps[i]) <= 4000 then case when open = '' then parts else list_append(parts, open) end
      else list_concat(case when open = '' then parts else list_append(parts, open) end, list_transform(range(0, (length(ps[i]) - 1) // 4000 + 1), lambda j: regexp_replace(substring(ps[i], j * 4000 + 1, 4000), '^\\s+|\\s+$', '', 'g'))) end,
    case when open <> '' and length(open) + 2 + length(ps[i]) <= 4000 then open || chr(10) || chr(10) || ps[i] when length(ps[i]) <= 4000 then ps[i] else '' end
  from f join q on f.page_id = q.page_id and f.section = q.section where i <= len(ps)),
e as (select f.page_id, f.section, case when open = '' then parts else list_append(parts, open) end as parts from f join q on f.page_id = q.page_id and f.section = q.section where i = len(ps) + 1
  union all select page_id, section, [body] from q where length(body) <= 4000),
u as (select page_id, section, unnest(parts) as text, unnest(range(len(parts))) as part from e)"""


@query(f"with {_PARTS} select page_id || '-' || (row_number() over (partition by page_id order by section, part) - 1) as chunk_id, page_id, (row_number() over (partition by page_id order by section, part) - 1)::int as chunk_index, text from u")
def chunk_rows(spark, sf_dir):
    return chunks.chunk_pages(derived(spark, sf_dir, fx.MARKDOWN)).select("chunk_id", "page_id", "chunk_index", "text")


@query(f"with m as ({fx.MANIFEST}) select page_id, case when page_id % 2 = 0 then 'Doc' else title end as title, case when page_id % 2 = 0 then null else web_url end as web_url, case when page_id % 2 = 0 then 'KEY' end as space_key, case when page_id % 2 = 0 then 3 else 0 end as version from m")
def chunk_metadata(spark, sf_dir):
    m = derived(spark, sf_dir, fx.MANIFEST)
    return chunks.chunk_metadata(m, m.where("page_id % 2 = 0").selectExpr("page_id", "'Doc' as title", "' ' as web_url", "'KEY' as space_key", "3 as version"))


@query(f"""with a as ({fx.ATTACHMENTS}),
u as (select * from a where status <> 'SKIPPED' and trim(summary) <> ''),
c as (select page_id, ord, file_name, detected_type, unnest([0, 1, 2, 4]) as k, unnest([null, 'SUMMARY', 'COMPONENTS', 'FLOW']) as kind, unnest([summary, summary, source || '; ' || lang, source]) as text from u),
n as (select *, row_number() over (partition by page_id order by ord, k) - 1 as ix from c where k = 0 or detected_type = 'DRAWIO_SOURCE')
select page_id || '-img-' || ix || coalesce('-' || kind, '') as chunk_id, page_id, ix::int as chunk_index, text, kind as semantic_type, file_name as asset_path from n""")
def image_chunks(spark, sf_dir):
    a = derived(spark, sf_dir, fx.ATTACHMENTS).selectExpr("page_id", "ord", "file_name as relative_path", "cast(null as string) as heading_path", "detected_type", "status", "summary", "array(source) as components", "array(lang, ' ') as labels", "cast(array() as array<string>) as relationships", "array(source) as user_actions", "cast(null as array<string>) as flow")
    return chunks.image_chunks(a).select("chunk_id", "page_id", "chunk_index", "text", "semantic_type", "asset_path")


@query(f"with a as ({fx.ATTACHMENTS}), p as (select doc_id as page_id from documents) select p.page_id, c.n as attachment_count from p left join (select page_id, count(*) as n from a group by page_id) c on c.page_id = p.page_id")
def attachment_counts(spark, sf_dir):
    return chunks.attachment_counts(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id")), derived(spark, sf_dir, fx.ATTACHMENTS).withColumnRenamed("file_name", "relative_path"))


# ---------------------------------------------------------------- manifest

_M = f"m as ({fx.MANIFEST}), e as (select *, case when no_of_retries > 0 or last_error is null or trim(last_error) = '' then greatest(0, no_of_retries) else 1 end as tries from m)"


@query(f"with {_M} select root_id, count(*) as total, count_if(markdown_extracted) as ingested, count_if(not markdown_extracted and tries < 2) as pending, count_if(tries > 0) as failed from e group by root_id")
def manifest_summary(spark, sf_dir):
    return manifest.summarize(derived(spark, sf_dir, fx.MANIFEST))


@query(f"with {_M} select root_id, count_if(not markdown_extracted and tries < 2) as pending_transform, count_if(markdown_extracted and not chunked and tries < 2) as pending_chunk, count_if(chunked and not vector_ingested and tries < 2) as pending_vector from e group by root_id")
def manifest_pending(spark, sf_dir):
    return manifest.pending_counts(derived(spark, sf_dir, fx.MANIFEST))


@query(f"with {_M} select page_id, title from e where not markdown_extracted and tries < 2 order by page_id limit 100")
def next_batch(spark, sf_dir):
    return manifest.next_batch(derived(spark, sf_dir, fx.MANIFEST), "transform").select("page_id", "title")


_CRAWL = f"c as (select root_id, page_id, 'New ' || title as title, web_url from ({fx.MANIFEST}) where page_id % 9 <> 0), o as (select * from ({fx.MANIFEST}) where page_id % 2 = 0)"


def _crawl(spark, sf_dir):
    m = derived(spark, sf_dir, fx.MANIFEST)
    return m.where("page_id % 9 <> 0").selectExpr("root_id", "page_id", "'New ' || title as title", "web_url"), m.where("page_id % 2 = 0")


@query(f"with {_CRAWL} select c.root_id, c.page_id, c.title, c.web_url, coalesce(markdown_extracted, false) as markdown_extracted, coalesce(chunked, false) as chunked, coalesce(vector_ingested, false) as vector_ingested, last_error, coalesce(no_of_retries, 0) as no_of_retries from c left join o on c.page_id = o.page_id and c.root_id = o.root_id")
def manifest_merge(spark, sf_dir):
    return manifest.merge_manifest(*_crawl(spark, sf_dir))


@query(f"with {_CRAWL} select root_id, page_id, 'vanished' as change from o where page_id not in (select page_id from c) union all select root_id, page_id, 'new' from c where page_id not in (select page_id from o)")
def manifest_diff(spark, sf_dir):
    return manifest.manifest_diff(*_crawl(spark, sf_dir))


@query(f"with m as ({fx.MANIFEST}) select root_id, page_id, case when page_id % 3 = 0 then true else markdown_extracted end as markdown_extracted, case when page_id % 3 = 0 then page_id % 2 = 0 else chunked end as chunked, case when page_id % 3 = 0 then null else last_error end as last_error from m")
def state_merge(spark, sf_dir):
    m = derived(spark, sf_dir, fx.MANIFEST)
    s = m.where("page_id % 3 = 0").selectExpr("root_id", "page_id", "true as markdown_extracted", "page_id % 2 = 0 as chunked", "false as vector_ingested", "cast(null as string) as last_error", "0 as no_of_retries", "'CHUNK' as stage", "2 as updated_at")
    old = s.withColumn("markdown_extracted", F.lit(False)).withColumn("updated_at", F.lit(1))
    return manifest.apply_state(m, s.unionByName(old)).select("root_id", "page_id", "markdown_extracted", "chunked", "last_error")


@query(f"""with {_M}, o as (select root_id, page_id, page_id % 3 <> 0 as success from m where page_id % 2 = 0)
  select e.root_id, e.page_id, coalesce(o.success, false) or e.chunked as chunked, case when o.success then null when o.success = false then 'failed ' || e.page_id else last_error end as last_error,
  (case when o.success then 0 when o.success = false then tries + 1 else no_of_retries end)::int as no_of_retries from e left join o on e.page_id = o.page_id and e.root_id = o.root_id""")
def apply_outcomes(spark, sf_dir):
    m = derived(spark, sf_dir, fx.MANIFEST)
    o = m.where("page_id % 2 = 0").selectExpr("root_id", "page_id", "page_id % 3 <> 0 as success", "concat('failed ', page_id) as error", "cast(null as string) as title", "cast(null as string) as web_url")
    return manifest.apply_outcomes(m, o, "chunk").select("root_id", "page_id", "chunked", "last_error", "no_of_retries")


@query(f"with {_M} select root_id, page_id, markdown_extracted or tries < 2 as markdown_extracted, case when tries < 2 and (not markdown_extracted or not chunked) then true else chunked end as chunked from e")
def resumed_run(spark, sf_dir):
    done = lambda pages: pages.selectExpr("root_id", "page_id", "true as success", "cast(null as string) as error", "title", "web_url")
    return manifest.run_pipeline(derived(spark, sf_dir, fx.MANIFEST), {"transform": done, "chunk": done}).select("root_id", "page_id", "markdown_extracted", "chunked")


@query(f"with o as ({fx.OUTCOMES}) select root_id, phase, count(*) as processed, count_if(not success) as failed, greatest(0, 1000 - count(*))::bigint as remaining from o group by root_id, phase")
def run_progress(spark, sf_dir):
    o = derived(spark, sf_dir, fx.OUTCOMES)
    return manifest.run_progress(o, o.select("root_id", "phase").distinct().withColumn("pending", F.lit(1000)))


@query(f"""with o as ({fx.OUTCOMES}), t as (select root_id, phase, arg_max(success::varchar, ts) as s from o group by root_id, phase)
  select root_id, string_agg('batch(' || phase || ')=' || s, '; ' order by phase) || '; manifest ' || case when root_id < 3 then 'present' else 'absent' end as message from t group by root_id""")
def run_status(spark, sf_dir):
    o = derived(spark, sf_dir, fx.OUTCOMES).withColumn("status", F.col("success").cast("string"))
    m = derived(spark, sf_dir, fx.MANIFEST).where("root_id < 3")
    return manifest.run_status(o.select("root_id").distinct(), o, m)


@query(f"with o as (select root_id, row_number() over (partition by root_id order by event_id) as n from ({fx.OUTCOMES})) select root_id, floor(n / 25)::bigint as step, max(n) as n from o group by root_id, floor(n / 25)")
def progress_ticks(spark, sf_dir):
    from pyspark.sql import Window

    o = derived(spark, sf_dir, fx.OUTCOMES).withColumn("n", F.row_number().over(Window.partitionBy("root_id").orderBy("event_id")).cast("long"))
    return jobs.progress_ticks(o).select("root_id", "step", "n")


# ---------------------------------------------------------------- tree

_TREE = f"""with recursive e as ({fx.EDGES}), t(page_id, path, position, depth) as (
  select child_id, []::int[], position, 1 from e where parent_id = 0
  union all select e.child_id, list_append(t.path, t.position), e.position, t.depth + 1 from t join e on e.parent_id = t.page_id)"""


@query(f"{_TREE} select page_id, depth from t")
def descendants(spark, sf_dir):
    return tree.descendants(derived(spark, sf_dir, fx.EDGES), 0).select("page_id", "depth")


@query(f"{_TREE} select page_id, row_number() over (order by path, position) as crawl_order from t union all select 0, 0")
def crawl_order(spark, sf_dir):
    return tree.crawl_rows(derived(spark, sf_dir, fx.EDGES), 0).select("page_id", "crawl_order")


# ---------------------------------------------------------------- markup

_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&#10;", "\n"), ("&#xa;", "\n"), ("&amp;", "&")]


def _decoded(x: str) -> str:
    for a, b in _ENTITIES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_BARE = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in ("script", "style", "nav", "footer"):
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_t}\\b.*?</{_t}>', '', 'g')"
_ARTICLE = f"""a as (select page_id, string_split_regex(regexp_extract({_BARE}, '(?is)<article[^>]*>(.*?)</article>', 1), '(?i)</?(?:p|h1|h2|h3|br|li|ul|ol|div)\\b[^>]*>') as parts from pages),
b as (select page_id, unnest(range(len(parts))) as pos, unnest(parts) as raw from a),
c as (select page_id, pos::int as pos, regexp_replace({_decoded("regexp_replace(raw, '<[^>]+>', '', 'g')")}, '^\\s+|\\s+$', '', 'g') as text from b)"""


@query(f"with {_ARTICLE} select page_id, pos, text from c where text <> ''")
def article_blocks(spark, sf_dir):
    return markup.article_blocks(load(spark, sf_dir, "pages"))


@query(f"with {_ARTICLE} select page_id, string_agg(text, chr(10) || chr(10) order by pos) as md from c where text <> '' group by page_id")
def page_markdown(spark, sf_dir):
    return markup.page_markdown(load(spark, sf_dir, "pages"))


@query("select page_id, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>'))::int as tags, regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '^\\s+|\\s+$', '', 'g') as heading from pages")
def heading_tokens(spark, sf_dir):
    return markup.heading_tokens(load(spark, sf_dir, "pages"))


_SHOWN = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in ("script", "style"):
    _SHOWN = f"regexp_replace({_SHOWN}, '(?is)<{_t}\\b.*?</{_t}>', '', 'g')"


@query(f"""with t as (select page_id, unnest(regexp_extract_all({_SHOWN}, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages)
  select page_id, tag, count(*) as n, case when tag = 'html' then 1 when tag in ('head', 'body') then 2 when tag in ('title', 'nav', 'div', 'article', 'footer') then 3
    when tag in ('h1', 'ul', 'p') then 4 when tag in ('li', 'b') then 5 when tag = 'a' then 6 end::int as outermost, outermost as innermost
  from t where tag not in ('br', 'meta') group by page_id, tag""")
def page_elements(spark, sf_dir):
    """Elements of raw pages by tag and level: a paragraph without an end holds no other one."""
    found = markup.nodes(markup.raw_tokens(load(spark, sf_dir, "pages"))).where("kind = 'open'")
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("level").alias("outermost"), F.max("level").alias("innermost"))


_STORED = """select doc_id as page_id, source as title, '<h2>' || lang || '</h2><p>One <strong> bold </strong> and <a href="http://x/' || doc_id || '">link</a></p><ol><li>' || source || '</li><li>b</li></ol><ul><li>u&#8211;1</li><li><em>u2</em></li></ul>'
  || '<blockquote>q1<br/>q2</blockquote><table><tr><th>' || lang || '</th><th>h</th></tr><tr><td>a|b</td><td>' || source || '</td></tr></table><table><tr><td colspan="2">w</td></tr><tr><td>1</td><td>2</td></tr></table>'
  || '<div>in <table><tr><td colspan="2">' || lang || '</td></tr></table></div><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">java</ac:parameter><ac:plain-text-body><![CDATA[int ' || lang || ';]]></ac:plain-text-body></ac:structured-macro>'
  || '<ac:structured-macro ac:name="info"><ac:rich-text-body><p>Note <em> ' || source || ' </em></p></ac:rich-text-body></ac:structured-macro><p><ac:link><ri:page ri:content-title="' || source || '"/></ac:link> <a>bare</a><a href="http://y"></a></p>'
  || '<p><ac:image><ri:attachment ri:filename="f' || doc_id || '.png"/></ac:image></p><p><img src="http://i/g' || doc_id || '.jpg"/></p><pre>x &lt; y</pre><hr/><p>'
  || replace(replace(text, '<', ' '), '&', ' ') || '</p>' as html, text, lang, source, doc_id from documents"""


@query(f"""with s as ({_STORED}), b as (select *, regexp_replace(replace(replace(text, '<', ' '), '&', ' '), '^\\s+|\\s+$', '', 'g') as body from s)
  select page_id, '# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || 'One **bold** and [link](http://x/' || doc_id || ')' || chr(10) || chr(10) || '1. ' || source || chr(10) || '2. b' || chr(10) || chr(10)
  || '- u–1' || chr(10) || '- *u2*' || chr(10) || chr(10) || '> q1' || chr(10) || '> q2' || chr(10) || chr(10) || '| ' || lang || ' | h |' || chr(10) || '| --- | --- |' || chr(10) || '| a\\|b | ' || source || ' |' || chr(10) || chr(10) || '[TABLE:table-1](assets/tables/table-1.json)'
  || chr(10) || chr(10) || 'in [TABLE:table-2](assets/tables/table-2.json)' || chr(10) || chr(10) || '```' || chr(10) || 'int ' || lang || ';' || chr(10) || '```' || chr(10) || chr(10) || 'Note *' || source || '*' || chr(10) || chr(10) || source || ' bare[http://y](http://y)'
  || chr(10) || chr(10) || '![f' || doc_id || '.png](assets/f' || doc_id || '.png)' || chr(10) || chr(10) || '```' || chr(10) || 'x < y' || chr(10) || '```' || chr(10) || chr(10) || '---' || case when body = '' then '' else chr(10) || chr(10) || body end as md from b""")
def storage_markdown(spark, sf_dir):
    """The whole Markdown of stored pages that hold each document's text beside every kind of block."""
    return markup.markdown(derived(spark, sf_dir, _STORED)).select("page_id", "md")


@query("select doc_id as page_id, unnest(['f' || doc_id || '.png', 'g' || doc_id || '.jpg']) as name from documents")
def image_refs(spark, sf_dir):
    pages = derived(spark, sf_dir, _STORED).selectExpr("page_id", "html || html as html")
    return markup.image_refs(markup.tokens(pages)).select("page_id", "name")


def _table_pages(spark, sf_dir) -> DataFrame:
    rows = derived(spark, sf_dir, fx.TABLE_ROWS).withColumnRenamed("table_id", "page_id")
    return assemble(rows, ["page_id"], ["row_ix"], "tr", "", "rows").select("page_id", F.concat(F.lit("<ac:layout><ac:layout-cell><table><caption> Parts </caption><tbody>"), "rows", F.lit("</tbody></table></ac:layout-cell></ac:layout>")).alias("html"))


_D4 = f"t as (select *, table_id % 3 = 0 and row_ix = 2 as is_span, table_id % 3 = 1 and row_ix = 3 as is_long, row_ix as r from ({fx.TABLE_ROWS}))"
_HARD = "select table_id from t where is_span or is_long"


@query(f"with {_D4} select table_id as page_id, r::int as row_ix, 0 as col_ix, p_name as text, case when is_span then 2 else 1 end as colspan from t union all select table_id, r::int, 1, p_brand || ' | x', 1 from t where not is_span union all select table_id, r::int, 2, 'more', 1 from t where is_long")
def table_cells(spark, sf_dir):
    return markup.table_cells(markup.tokens(_table_pages(spark, sf_dir))).select("page_id", "row_ix", "col_ix", "text", "colspan")


@query(f"with {_D4} select table_id as page_id, count(*)::int as row_count, case when bool_or(is_long) then 3 else 2 end as column_count, bool_or(is_long) as ragged, bool_or(is_span) as spanned, false as nested from t group by table_id")
def table_shapes(spark, sf_dir):
    return markup.table_shapes(markup.table_cells(markup.tokens(_table_pages(spark, sf_dir)))).drop("table_ix")


@query(f"""with {_D4}, s as (select * from t where table_id not in ({_HARD})) select table_id as page_id, string_agg('| ' || p_name || ' | ' || p_brand || ' \\| x |' || case when r = 0 then chr(10) || '| --- | --- |' else '' end, chr(10) order by r) as pipe from s group by table_id""")
def pipe_tables(spark, sf_dir):
    return markup.pipe_tables(markup.table_cells(markup.tokens(_table_pages(spark, sf_dir)))).select("page_id", "pipe")


@query(f"with {_D4}, h as (select table_id as page_id, count(*)::int as row_count from t where table_id in ({_HARD}) group by table_id) select page_id, 'table-' || n as table_id, row_count, 'Parts' as caption from h, (select unnest([1, 2]) as n)")
def complex_tables(spark, sf_dir):
    """Pages with their table twice, so that numbers above 1 occur."""
    pages = _table_pages(spark, sf_dir).selectExpr("page_id", "html || html as html")
    return markup.extract_tables(markup.tokens(pages)).select("page_id", "table_id", "row_count", "caption")


_MACRO = "select doc_id as page_id, '<p>a</p><ac:structured-macro ac:name=\"drawio\"><ac:parameter ac:name=\"diagramName\">d' || doc_id || '</ac:parameter>' || case when doc_id % 2 = 0 then '<ac:plain-text-body><![CDATA[<mxGraphModel>' || doc_id || '</mxGraphModel>]]></ac:plain-text-body>' else '' end || '</ac:structured-macro>' as html from documents"


@query("select doc_id as page_id, 'diagram-1' as diagram_id, case when doc_id % 2 = 0 then 'embedded' when doc_id % 3 = 0 then 'guessed' end as source, case when doc_id % 2 = 0 then '<mxGraphModel>' || doc_id || '</mxGraphModel>' when doc_id % 3 = 0 then '<mxfile>' || lang || '</mxfile>' end as content from documents")
def diagram_sources(spark, sf_dir):
    refs = markup.diagram_refs(markup.tokens(derived(spark, sf_dir, _MACRO)))
    drawn = load(spark, sf_dir, "documents").where("doc_id % 3 = 0").selectExpr("doc_id as page_id", "concat('d', doc_id, '.drawio') as title", "concat('<mxfile>', lang, '</mxfile>') as content")
    return att.resolve_diagrams(refs, drawn)


# ---------------------------------------------------------------- attachments


@query("select url, case when regexp_extract(url, '[?&]pageId=(\\d+)', 1) <> '' then regexp_extract(url, '[?&]pageId=(\\d+)', 1) when regexp_extract(url, '/pages/(\\d+)', 1) <> '' then regexp_extract(url, '/pages/(\\d+)', 1) end as page_ref, 'http://w' || regexp_extract(url, '(/[a-z]+/.*)$', 1) as web from pages")
def url_functions(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"(/[a-z]+/.*)$", 1)
    return p.select("url", fn.page_id_of(F.col("url")).alias("page_ref"), fn.web_url(F.lit("http://w/"), path, F.col("page_id")).alias("web"))


@query(f"with a as ({fx.ATTACHMENTS}) select file_name, lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) as ext, replace(source || '_' || file_name, ':', '_') as safe, '![' || file_name || '](assets/' || file_name || ')' as mark from a")
def file_names(spark, sf_dir):
    a = derived(spark, sf_dir, fx.ATTACHMENTS)
    return a.select("file_name", fn.extension(F.col("file_name")).alias("ext"), fn.safe_name(F.concat("source", F.lit(":"), "file_name")).alias("safe"), fn.placeholder("image", F.col("file_name")).alias("mark"))


_MIME = "coalesce(declared_mime, case doc_id % 10 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/svg+xml' when 3 then 'application/pdf' when 4 then 'application/vnd.openxmlformats-officedocument.presentationml.presentation' when 5 then 'application/vnd.ms-visio.drawing' when 6 then 'application/vnd.jgraph.mxfile' end, case doc_id % 5 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'application/pdf' when 3 then 'application/zip' end)"


@query(f"""with a as (select ord as doc_id, * exclude (detected_type) from ({fx.ATTACHMENTS})), m as (select *, {_MIME} as mime_type from a)
  select file_name, mime_type, case when doc_id % 10 = 7 then 'OTHER' when doc_id % 10 = 6 then 'DRAWIO_SOURCE' when doc_id % 10 = 5 then 'VISIO_SOURCE' when doc_id % 10 = 2 then 'SVG_DIAGRAM' when doc_id % 10 = 3 or mime_type = 'application/pdf' or magic = '25504446' then 'PDF_DOCUMENT'
    when doc_id % 10 = 4 then 'PRESENTATION' when mime_type like 'image/%' then 'GENERIC_IMAGE' else 'UNKNOWN' end as detected_type from m""")
def attachment_classify(spark, sf_dir):
    a = derived(spark, sf_dir, fx.ATTACHMENTS).drop("detected_type").withColumn("content", F.unhex("magic"))
    return att.classify(a).select("file_name", "mime_type", "detected_type")


@query(f"with a as ({fx.ATTACHMENTS}) select page_id, file_name, sha256(magic) as checksum, ord % 2 = 0 as cached from a")
def attachment_cache(spark, sf_dir):
    a = derived(spark, sf_dir, fx.ATTACHMENTS).selectExpr("page_id", "file_name as relative_path", "cast(magic as binary) as content", "ord")
    prev = a.where("ord % 2 = 0").select("page_id", "relative_path", fn.checksum(F.col("content")).alias("checksum"), F.lit(1).alias("schema_version"), F.lit(None).cast("string").alias("vision_model"))
    out = att.analyze_incremental(a, prev, lambda rest: rest.select("page_id", "relative_path", "checksum", F.lit("EXTENSION").alias("detection_method")))
    return out.select("page_id", F.col("relative_path").alias("file_name"), "checksum", (F.col("detection_method") == "CACHED").alias("cached"))


@query(f"with a as ({fx.ATTACHMENTS}) select file_name, case when status = 'SKIPPED' then 'SKIPPED' when trim(summary) <> '' then 'SUCCESS' else 'PARTIAL' end as outcome from a")
def attachment_status(spark, sf_dir):
    a = derived(spark, sf_dir, fx.ATTACHMENTS)
    return a.select("file_name", att.extraction_status(F.when(F.col("status") == "SKIPPED", F.lit("x")), F.lit(None), F.col("summary")).alias("outcome"))


@query(f"with a as ({fx.ATTACHMENTS}), d as (select cast(floor(doc_id / 5) as bigint) as page_id, doc_id from documents) select d.page_id, d.doc_id::int as pos, a.file_name as relative_path from d join a on a.ord = d.doc_id")
def link_match(spark, sf_dir):
    a = derived(spark, sf_dir, fx.ATTACHMENTS).selectExpr("page_id", "ord", "file_name", "'assets/' || file_name as relative_path")
    lines = a.selectExpr("page_id", "int(ord) as pos", "'see ![a](./assets/' || file_name || ') and ![b](' || file_name || ')' as line")
    return att.match_links(lines, a).select("page_id", "pos", F.expr("substring(relative_path, 8)").alias("relative_path"))


@query(f"""with m as ({fx.MARKDOWN}) select page_id, page_id % 2 = 0 as enriched, case when page_id % 2 = 1 then md else
  replace(md, '![a](assets/f' || page_id || '.png)', '![a](assets/f' || page_id || '.png)' || chr(10) || chr(10) || '### Extracted Attachment Information' || chr(10) || chr(10) || 'File: f' || page_id || '.png' || chr(10)
  || 'Attachment Type: Photo' || chr(10) || chr(10) || 'Summary:' || chr(10) || chr(10) || 'About ' || source || chr(10) || chr(10) || 'Labels:' || chr(10) || chr(10) || '- ' || lang || chr(10) || chr(10) || '---') end as md from m""")
def enrich_markdown(spark, sf_dir):
    md = derived(spark, sf_dir, fx.MARKDOWN)
    a = md.where("page_id % 2 = 0").selectExpr("page_id", "'assets/f' || page_id || '.png' as relative_path", "'f' || page_id || '.png' as file_name", "'PHOTO' as detected_type", "'About ' || source as summary", "array(lang) as labels", "cast(null as array<string>) as components", "cast(null as array<string>) as relationships")
    return att.enrich_markdown(md.select("page_id", "md"), a)


@query(f"with m as ({fx.MARKDOWN}) select 'c' || page_id as chunk_id, page_id from m union all select 'i' || page_id, page_id from m where page_id % 2 = 1")
def all_chunks(spark, sf_dir):
    """Image chunks stay only for pages whose text doesn't hold their attachments yet."""
    md = derived(spark, sf_dir, fx.MARKDOWN).withColumn("md", F.when(F.col("page_id") % 2 == 0, F.concat("md", F.lit("\n" + att.ENRICHMENT_HEADING))).otherwise(F.col("md")))
    one = lambda mark: md.select(F.concat(F.lit(mark), F.col("page_id").cast("string")).alias("chunk_id"), "page_id")
    return chunks.all_chunks(one("c"), one("i"), md)


@query("""select c_custkey as page_id, case when c_custkey % 2 = 0 then c_name end as title, c_mktsegment || 'x' || c_custkey || 'y|' || c_mktsegment || '|x' || c_custkey as shown,
  'SVG diagram: ' || case when c_custkey % 2 = 0 then c_name else c_mktsegment || 'x' || c_custkey || 'y, ' || c_mktsegment || ', x' || c_custkey end as summary from customer""")
def svg_text(spark, sf_dir):
    """Every other file has a title; a text element goes on behind the tspan in it."""
    title, body = "case when c_custkey % 2 = 0 then '<title> ' || c_name || ' </title>' else '' end", "c_mktsegment || '<tspan>x' || c_custkey || '</tspan>y</text><text>' || c_mktsegment || '</text></g></svg>'"
    svg = load(spark, sf_dir, "customer").selectExpr("c_custkey as page_id", f"'<svg id=\"a\">' || {title} || '<g><text>' || {body} as html")
    return att.svg_text(svg).select("page_id", "title", F.array_join("visible_text", "|").alias("shown"), "summary")


# ---------------------------------------------------------------- diagrams


def _files(spark, sf_dir) -> DataFrame:
    rows = derived(spark, sf_dir, fx.DIAGRAM_CELLS).withColumn("diagram_id", F.col("g").cast("string"))
    body = assemble(rows, ["diagram_id"], ["ord"], "xml", "", "body")
    return body.select("diagram_id", F.concat(F.lit("<mxGraphModel><root>"), "body", F.lit("</root></mxGraphModel>")).alias("xml"))


def _cells(spark, sf_dir) -> DataFrame:
    return diagrams.diagram_cells(_files(spark, sf_dir))


def _graph(spark, sf_dir):
    """Cells, types, nodes and edges, each written once, since most operators read several of them."""
    cells = stored(_cells(spark, sf_dir), "cells")
    types = stored(diagrams.classify_diagrams(cells), "types")
    nodes = stored(diagrams.diagram_nodes(cells, types), "nodes")
    return cells, types, nodes, stored(diagrams.diagram_edges(cells, types, nodes), "edges")


# Members, hubs, and what the operators make of them: nodes, edges and labels in the order of the cells.
_D6 = f"""m as ({fx.MEMBERS}), h as (select g, any_value(kind) as kind, any_value(hub) as hub from m group by g),
t as (select g::varchar as diagram_id, g, kind, hub, case kind when 0 then 'ARCHITECTURE_DIAGRAM' when 1 then 'STATE_DIAGRAM' when 2 then 'GENERIC_DIAGRAM' when 3 then 'ER_DIAGRAM' else 'CLASS_DIAGRAM' end as type from h),
n as (select g, -1 as o, hub as label, case kind when 0 then 'supporting-service' when 1 then 'state' when 2 then null when 3 then 'table' else 'class' end as type, case when kind = 4 then '+id: Long' end as child from h
  union all select g, c_custkey, label, case kind when 0 then 'controller-layer' when 1 then 'state' when 2 then 'rounded=1' when 3 then 'table' else 'class' end, child from m),
e as (select g, c_custkey as o, label as source, hub as target, case kind when 1 then 'approve' when 3 then 'references' when 4 then case when c_custkey % 2 = 1 then 'implements' else 'extends' end end as label,
  case kind when 3 then 'reference' when 4 then case when c_custkey % 2 = 1 then 'implements' else 'extends' end end as relation from m),
l as (select g, -1 as o, 0 as k, hub as label from h union all select g, c_custkey, 0, label from m union all select g, c_custkey, 1, child from m where child is not null union all select g, min(c_custkey), 2, 'approve' from m where kind = 1 group by g),
x as (select g, list(label order by o, k) as labels from l group by g),
y as (select g, list(label order by o) as names, list('| ' || label || ' |  |' order by o) as states, list('| ' || label || ' | Class | ' || coalesce(child, '') || ' |' order by o) as classes, list('| ' || label || ' | ' || coalesce(child, '') || ' |' order by o) as tables from n group by g),
z as (select g, list('| ' || source || ' | ' || coalesce(label, '') || ' | ' || target || ' |' order by o) as moves, list('| ' || source || ' | ' || target || ' | ' || coalesce(label, '') || ' |' order by o) as refs, list('- ' || source || ' -> ' || coalesce(label || ' -> ', '') || target order by o) as arrows,
  list(source || ' ' || coalesce(relation, '') || ' ' || target order by o) as facts, min_by(source, o) as first from e group by g),
u as (select t.*, labels, names, states, classes, tables, moves, refs, arrows, case kind when 0 then 'Architecture diagram containing supporting service, controller layer.' when 1 then 'Workflow begins in ' || first || ' and can move to ' || hub || '.'
  when 4 then array_to_string(facts[1:2], '; ') || '.' else case kind when 2 then 'Generic Diagram' else 'Er Diagram' end || ' containing: ' || array_to_string(labels[1:12], ', ') || '.' end as summary from t join x on x.g = t.g join y on y.g = t.g join z on z.g = t.g)"""


@query(f"with {_D6} select g::varchar as diagram_id, 'n' as cell_id, hub as value, true as vertex, null as target_id from h union all select g::varchar, 'c' || c_custkey, label, true, null from m union all select g::varchar, 'k' || c_custkey, child, true, null from m where child is not null union all select g::varchar, 'e' || c_custkey, case when kind = 1 then 'approve' else '' end, false, 'n' from m")
def diagram_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("diagram_id", "cell_id", "value", "vertex", "target_id")


@query(f"with {_D6} select diagram_id, type from t")
def diagram_type(spark, sf_dir):
    return diagrams.classify_diagrams(_cells(spark, sf_dir))


@query(f"with {_D6} select t.diagram_id, n.label, n.type, case when t.kind = 3 then coalesce(n.child, '') else '' end as columns, case when t.kind = 4 then coalesce(n.child, '') else '' end as members from n join t on t.g = n.g")
def diagram_nodes(spark, sf_dir):
    cells = stored(_cells(spark, sf_dir), "cells")
    types = stored(diagrams.classify_diagrams(cells), "types")
    both, is_er = F.array_join("attributes", ","), F.col("dtype") == "ER_DIAGRAM"
    nodes = diagrams.diagram_nodes(cells, types).join(types.withColumnRenamed("type", "dtype"), "diagram_id")
    return nodes.select("diagram_id", "label", "type", F.when(is_er, both).otherwise("").alias("columns"), F.when(is_er, "").otherwise(both).alias("members"))


@query(f"with {_D6} select g::varchar as diagram_id, source, target, label, relation as relationship_type from e")
def diagram_edges(spark, sf_dir):
    """Edges of tables and classes begin at a child and climb to the node that holds it."""
    return _graph(spark, sf_dir)[3].select("diagram_id", "source", "target", "label", "relationship_type")


@query(f"with {_D6} select g::varchar as diagram_id, case when child is null then 'c' else 'k' end || c_custkey as cell_id, 1 as outgoing, 0 as incoming from m union all select g::varchar, 'n', 0, count(*) from m group by g")
def diagram_degrees(spark, sf_dir):
    return diagrams.degrees(_cells(spark, sf_dir))


@query(f"with {_D6} select diagram_id, summary from u")
def diagram_summary(spark, sf_dir):
    cells, types, nodes, edges = _graph(spark, sf_dir)
    return diagrams.diagram_summary(types, cells, nodes, edges)


@query(f"with {_D6} select diagram_id, g % 4 <> 1 and g % 4 <> 2 as valid from t")
def diagram_valid(spark, sf_dir):
    """Of four diagrams one gets a raw id as a node and one a repeated edge."""
    _, types, nodes, edges = _graph(spark, sf_dir)
    raw = types.where("int(diagram_id) % 4 = 1").selectExpr("diagram_id", "'deadbeef' as label")
    again = edges.where("int(diagram_id) % 4 = 2")
    return diagrams.valid_diagrams(types, nodes.unionByName(raw, allowMissingColumns=True), edges.unionByName(again))


_NL = "chr(10) || chr(10)"
_LINES = lambda c, k=None: f"array_to_string({c}{f'[1:{k}]' if k else ''}, chr(10))"
_SECTIONS_OF = f"""case kind
  when 0 then 'Architecture Summary:' || {_NL} || summary || {_NL} || 'Controller Layer:' || {_NL} || {_LINES("list_transform(names[2:], lambda x: '- ' || x)", 40)} || {_NL} || 'Supporting Services:' || {_NL} || '- ' || hub
  when 1 then 'Workflow Summary:' || {_NL} || summary || {_NL} || 'States' || {_NL} || '| State | Description |' || chr(10) || '|---|---|' || chr(10) || {_LINES("states")} || {_NL} || 'Transitions' || {_NL} || '| From | Event | To |' || chr(10) || '|---|---|---|' || chr(10) || {_LINES("moves")}
  when 2 then 'Diagram Summary:' || {_NL} || summary || {_NL} || 'Key Labels:' || {_NL} || {_LINES("list_transform(labels, lambda x: '- ' || x)", 20)} || {_NL} || 'Components:' || {_NL} || {_LINES("list_transform(names, lambda x: '- ' || x)", 40)} || {_NL} || 'Relationships:' || {_NL} || {_LINES("arrows", 40)}
  when 3 then 'Data Model Summary:' || {_NL} || summary || {_NL} || 'Tables' || {_NL} || '| Table | Columns |' || chr(10) || '|---|---|' || chr(10) || {_LINES("tables")} || {_NL} || 'Relationships' || {_NL} || '| Source Table | Target Table | Join/Reference |' || chr(10) || '|---|---|---|' || chr(10) || {_LINES("refs")}
  else 'Domain Summary:' || {_NL} || summary || {_NL} || 'Classes' || {_NL} || '| Class | Type | Attributes |' || chr(10) || '|---|---|---|' || chr(10) || {_LINES("classes")} || {_NL} || 'Relationships' || {_NL} || '| Source | Relationship | Target |' || chr(10) || '|---|---|---|' || chr(10) || {_LINES("moves")} end
  || {_NL} || '<details>' || chr(10) || '<summary>Raw extracted labels</summary>' || {_NL} || {_LINES("list_transform(labels, lambda x: '- ' || x)", 200)} || {_NL} || '</details>'"""


@query(f"with {_D6} select diagram_id, {_SECTIONS_OF} as sections from u")
def diagram_sections(spark, sf_dir):
    cells, types, nodes, edges = _graph(spark, sf_dir)
    return diagrams.diagram_sections(types, cells, nodes, edges)


@query(f"with {_D6} select diagram_id, len(names) as node_count, len(arrows) as edge_count, len(labels) as label_count, array_to_string(names, '; ') as components, array_to_string(list_transform(arrows, lambda x: x[3:]), '; ') as relationships from u")
def diagram_counts(spark, sf_dir):
    cells, _, nodes, edges = _graph(spark, sf_dir)
    out = diagrams.diagram_metadata(cells, nodes, edges)
    return out.select("diagram_id", "node_count", "edge_count", "label_count", F.array_join("components", "; ").alias("components"), F.array_join("relationships", "; ").alias("relationships"))


@query(f"with {_D6} select 'p' || diagram_id || '.drawio' as diagram_id, type, true as valid, summary, len(names) as node_count, len(arrows) as edge_count from u")
def analyze_diagrams(spark, sf_dir):
    """Diagram files of attachments in one call; other attachments are left aside."""
    drawn = _files(spark, sf_dir).select(F.concat(F.lit("p"), "diagram_id", F.lit(".drawio")).alias("relative_path"), F.encode("xml", "UTF-8").alias("content"))
    other = drawn.select(F.regexp_replace("relative_path", "drawio", "png").alias("relative_path"), "content")
    return diagrams.analyze_diagrams(diagrams.diagram_files(drawn.unionAll(other))).select("diagram_id", "type", "valid", "summary", "node_count", "edge_count")


_PAGED = f"""{_D6}, f as (select *, g // 2 as f, kind = 1 as is_state from u),
c as (select f, case f % 3 when 0 then coalesce(min(case when is_state then g end), min(g)) when 1 then max(g) else min(g) end as g, min(g) as g0 from f group by f)"""


@query(f"with {_PAGED} select 'dir/' || case c.f % 3 when 0 then 'state' when 1 then 'plan-' else 'q' end || c.f || '.drawio' as diagram_id, (c.g - g0)::int as page_ix, case when c.g = g0 then 'First' else 'Plan' end as diagram_name, type, summary, len(names) as node_count, len(arrows) as edge_count, len(labels) as label_count from c join u on u.g = c.g")
def diagram_pages(spark, sf_dir):
    """Files of two pages with the same cell ids; the file's name tells the page by type or by the page's name, or fits none."""
    name = F.when(F.col("f") % 3 == 0, "state").when(F.col("f") % 3 == 1, "plan-").otherwise("q")
    pages = _files(spark, sf_dir).selectExpr("*", "cast(diagram_id as bigint) div 2 as f", "cast(diagram_id as bigint) % 2 as k")
    body = F.concat(F.when(F.col("k") == 0, '<diagram id="a" name="First">').otherwise('<diagram name=" Plan ">'), "xml", F.lit("</diagram>"))
    held = assemble(pages.withColumn("body", body), ["f"], ["k"], "body", "", "xml")
    content = F.encode(F.concat(F.lit('<mxfile><mxCell id="n" value="none of theirs"/>'), "xml", F.lit("</mxfile>")), "UTF-8")
    found = diagrams.diagram_files(held.select(F.concat(F.lit("dir/"), name, F.col("f").cast("string"), F.lit(".drawio")).alias("relative_path"), content.alias("content")))
    return diagrams.analyze_diagrams(found).select("diagram_id", "page_ix", "diagram_name", "type", "summary", "node_count", "edge_count", "label_count")


# ---------------------------------------------------------------- streams


@query(f"with j as ({fx.JOBS}) select message_id, root_id, job_type from (select distinct message_id, root_id, job_type from j where message_id is not null) union all select message_id, root_id, job_type from j where message_id is null")
def stream_jobs(spark, sf_dir):
    """Runs the job stream to its end; the result is what its sink holds."""
    path = scratch(spark, "jobs")
    rows = derived(spark, sf_dir, fx.JOBS).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{path}/in")
    out = jobs.dedupe_jobs(jobs.job_stream(spark, f"{path}/in"), "3650 days")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("message_id", "root_id", "job_type")


@query("select user_id as root_id, max(ts) as ts from events group by user_id")
def stream_upsert(spark, sf_dir):
    """Upserts a stream of events by user into version folders; the last version is the result."""
    path = scratch(spark, "upsert")
    load(spark, sf_dir, "events").selectExpr("cast(event_id as string) as message_id", "user_id as root_id", "event_type as job_type", "cast(ts as timestamp) as ts").repartition(4).write.parquet(f"{path}/in")
    stream = jobs.job_stream(spark, f"{path}/in")
    jobs.stream_upsert(stream, f"{path}/out", ["root_id"], f"{path}/ck").awaitTermination()
    return jobs.read_target(spark, f"{path}/out", stream.schema).selectExpr("root_id", "cast(ts as timestamp_ntz) as ts")


@query(f"""with t as (select *, discovered // 25 as d, processed // 25 as p from ({fx.TICKS})),
  w as (select *, lag(d, 1, 0) over (partition by root_id order by seq) as d0, lag(p, 1, 0) over (partition by root_id order by seq) as p0 from t)
  select root_id, seq, processed, discovered, page_id, title from w where d > d0 or p > p0""")
def crawl_ticks(spark, sf_dir):
    """Ticks stream in and are throttled; the stream stops midway, and its second run goes on from the state of the first."""
    path, ticks = scratch(spark, "ticks"), derived(spark, sf_dir, fx.TICKS)
    for half in ("seq < 210", "seq >= 210"):
        ticks.where(half).write.mode("append").parquet(f"{path}/in")
        out = jobs.crawl_ticks(jobs.job_stream(spark, f"{path}/in", jobs.TICK))
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


# ---------------------------------------------------------------- matching of attachments and diagrams


@query(f"with a as ({fx.ATTACHMENTS}) select page_id, file_name as name, ord % 4 <> 0 as found from a")
def image_resolution(spark, sf_dir):
    a = derived(spark, sf_dir, fx.ATTACHMENTS)
    listed = a.where("ord % 4 <> 0").selectExpr("page_id", "file_name as title", "ord", "declared_mime as media_type")
    found, missing = att.resolve_images(a.selectExpr("page_id", "file_name as name"), listed)
    return found.select("page_id", "name", F.lit(True).alias("found")).unionByName(missing.select("page_id", "name", F.lit(False).alias("found")))


@query(f"with a as ({fx.ATTACHMENTS}) select page_id, file_name, case when ord % 3 <> 0 then 2 * ord end as asset_size from a")
def asset_meta(spark, sf_dir):
    a = derived(spark, sf_dir, fx.ATTACHMENTS)
    known = a.where("ord % 3 <> 0").selectExpr("page_id", "file_name", "explode(array(named_struct('k', 0, 's', ord), named_struct('k', 1, 's', 2 * ord))) as x").selectExpr("page_id", "file_name", "x.k as ord", "x.s as size")
    return att.with_asset_meta(a.select("page_id", "file_name"), known).select("page_id", "file_name", "asset_size")


@query("select doc_id as page_id, 'f' || doc_id || '.png' as file_name, source || ' > ' || lang as heading_path from documents")
def attachment_headings(spark, sf_dir):
    lines = chunks.heading_paths(chunks.lines(derived(spark, sf_dir, fx.MARKDOWN)))
    a = load(spark, sf_dir, "documents").selectExpr("doc_id as page_id", "concat('./assets/f', doc_id, '.png') as relative_path", "concat('f', doc_id, '.png') as file_name")
    return att.with_heading_path(a, att.asset_headings(lines)).select("page_id", "file_name", "heading_path")


@query("select c_custkey as file_id, case when c_custkey % 3 = 2 then 0 else 1 end::int as page_ix, case c_custkey % 3 when 0 then 14 when 1 then 12 else 100 end as score from customer")
def pick_diagram(spark, sf_dir):
    """By the name and labels, by the name alone, or by the type that the file's name tells."""
    c = load(spark, sf_dir, "customer").selectExpr("*", "cast(c_custkey % 3 as int) as way")
    pages = c.selectExpr("c_custkey as file_id", "case when way = 2 then 'state.drawio' else concat(c_mktsegment, '-plan.drawio') end as file_name", "c_mktsegment", "way", "explode(array(0, 1)) as page_ix")
    pages = pages.selectExpr("file_id", "file_name", "page_ix", "case when page_ix = 1 then c_mktsegment else 'other' end as diagram_name", "case when page_ix = 1 and way = 0 then array(c_mktsegment) else array() end as labels", "case when way = 2 and page_ix = 0 then 'STATE_DIAGRAM' else 'GENERIC_DIAGRAM' end as type")
    return diagrams.pick_diagram(pages).select("file_id", "page_ix", "score")


@query("select doc_id as page_id, 'diagram-1' as diagram_id, case when doc_id % 2 = 0 then '[DIAGRAM:diagram-1](assets/diagrams/diagram-1.json)' || chr(10) || chr(10) || '- ' || lang || chr(10) || '- ' || source else '[DIAGRAM:diagram-1 (unavailable)]' end as md from documents")
def inline_diagrams(spark, sf_dir):
    refs = markup.diagram_refs(markup.tokens(derived(spark, sf_dir, _MACRO)))
    labels = load(spark, sf_dir, "documents").where("doc_id % 2 = 0").selectExpr("doc_id as page_id", "'diagram-1' as diagram_id", "posexplode(array(lang, source)) as (ord, label)")
    return markup.inline_diagrams(refs, labels)


@query(f"with a as (select a.*, d.text from ({fx.ATTACHMENTS}) a join documents d on d.doc_id = a.ord) select page_id, file_name, case when strlen(text) > 4096 then 'File exceeds 4096 bytes limit' end as skip_reason, sha256(text) as checksum, case when ord % 2 = 0 then 'Summary ' || lang end as title from a")
def attachment_facts(spark, sf_dir):
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.encode("text", "UTF-8").alias("content"))
    rows = att.size_guard(derived(spark, sf_dir, fx.ATTACHMENTS).join(texts, "ord"), max_bytes=4096)
    rows = rows.withColumn("title", F.expr("case when ord % 2 = 0 then 'Summary ' || lang end"))
    rows = att.attachment_metadata(rows.withColumn("checksum", fn.checksum(F.col("content"))))
    return rows.select("page_id", "file_name", "skip_reason", "checksum", F.col("metadata.title").alias("title"))


# ---------------------------------------------------------------- stores


@query(f"with {_PARTS}, c as (select page_id || '-' || (row_number() over (partition by page_id order by section, part) - 1) as chunk_id, page_id, text from u) select chunk_id, page_id % 9 as root_id, page_id, case when page_id % 3 = 0 then 'new' else text end as text from c where page_id % 3 <> 0 or chunk_id = page_id || '-0'")
def chunk_store(spark, sf_dir):
    """Chunks as JSON lines are read into a store; then a third of the pages is rewritten with one chunk each."""
    path = scratch(spark, "chunks")
    rows = chunks.chunk_pages(derived(spark, sf_dir, fx.MARKDOWN)).withColumn("root_id", F.col("page_id") % 9)
    files.artifacts(rows, []).write.text(f"{path}/in", compression="gzip")
    good, _ = files.read_chunks(spark, f"{path}/in")
    files.write_chunks(good, f"{path}/out")
    files.write_chunks(good.where("page_id % 3 = 0 and chunk_index = 0").withColumn("text", F.lit("new")), f"{path}/out")
    return files.read_store(spark, f"{path}/out").select("chunk_id", F.col("root_id").cast("long").alias("root_id"), "page_id", "text")


@query(f"{_UPSERT} select coalesce(b.chunk_id, a.chunk_id) as chunk_id, coalesce(b.root_id, a.root_id) as root_id, coalesce(b.batch, a.batch) as batch from a full join b on a.chunk_id = b.chunk_id")
def vector_store(spark, sf_dir):
    """Two writes into a collection, the second with every row twice."""
    path, v = scratch(spark, "vectors"), derived(spark, sf_dir, fx.VECTORS)
    files.write_vectors(v.where("vec_id % 3 <> 0").selectExpr("chunk_id", "root_id", "1 as batch"), path)
    new = v.where("vec_id % 2 = 0").selectExpr("chunk_id", "root_id + 100 as root_id", "2 as batch")
    files.write_vectors(new.unionAll(new.selectExpr("chunk_id", "root_id", "0 as batch")), path)
    return files.read_store(spark, path).select("chunk_id", "root_id", "batch")


@query(f"with a as ({fx.ATTACHMENTS}) select page_id, file_name, case when page_id % 2 = 0 then 'second' else status end as status from a")
def attachment_store(spark, sf_dir):
    path, a = scratch(spark, "attachments"), derived(spark, sf_dir, fx.ATTACHMENTS).select("page_id", "file_name", "status")
    files.write_attachments(a, path)
    files.write_attachments(a.where("page_id % 2 = 0").withColumn("status", F.lit("second")), path)
    return files.read_store(spark, path).select("page_id", "file_name", "status")


@query(f"select root_id, page_id, title, web_url, markdown_extracted, chunked, last_error, no_of_retries from ({fx.MANIFEST})")
def manifest_store(spark, sf_dir):
    """Manifests written as a JSON file per root and read back."""
    path = files.write_manifest(derived(spark, sf_dir, fx.MANIFEST), scratch(spark, "manifests"))
    return files.read_manifest(spark, path).select("root_id", "page_id", "title", "web_url", "markdown_extracted", "chunked", "last_error", "no_of_retries")


@query(f"with m as ({fx.MANIFEST}) select root_id, page_id, case when page_id % 3 = 0 then 'again ' || title else title end as title from m")
def crawl_dedupe(spark, sf_dir):
    """Pages that a crawl met twice stay at their first place."""
    m = derived(spark, sf_dir, fx.MANIFEST).withColumn("crawl_order", F.col("page_id") + 1000)
    again = m.where("page_id % 3 = 0").withColumn("title", F.concat(F.lit("again "), "title")).withColumn("crawl_order", F.col("page_id"))
    return manifest.dedupe_pages(m.unionByName(again)).select("root_id", "page_id", "title")


@query(f"with a as ({fx.ATTACHMENTS}) select file_name, regexp_matches(file_name, '(?i)\\.(png|pdf)$') as allowed, true as key_like, false as id_like from a")
def name_rules(spark, sf_dir):
    a = derived(spark, sf_dir, fx.ATTACHMENTS)
    return a.select("file_name", fn.allowed_extension(F.col("file_name"), ("png", "pdf")).alias("allowed"), fn.is_space_key(F.concat("lang", F.lit("_1"))).alias("key_like"), fn.is_space_key(F.concat(F.lit("1"), "lang")).alias("id_like"))


_LETTERS = "aeinrst"


@query(f"""with {_PARTS}, c as (select page_id || '-' || (row_number() over (partition by page_id order by section, part) - 1) as chunk_id, page_id, row_number() over (partition by page_id order by section, part) - 1 as k, text from u),
  v as (select chunk_id, page_id, k, [length(text)::double, {", ".join(f"(10 * (length(text) - length(replace(text, '{x}', ''))))::double" for x in _LETTERS)}] as e from c),
  s as (select q.chunk_id as query_id, v.chunk_id, round(list_cosine_similarity(q.e, v.e), 9) as score from v q, v where q.page_id % 50 = 0 and q.k = 0)
  select query_id, chunk_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s) where rank = 1""")
def ingest_search(spark, sf_dir):
    """From page text to hits: Markdown, chunks, vectors by a user function, the collection, and the best hit of each query."""
    rows = chunks.chunk_pages(derived(spark, sf_dir, fx.MARKDOWN))
    made = vectors.embed(rows, lambda texts: [[float(len(t)), *[10.0 * t.count(x) for x in _LETTERS]] for t in texts])
    path = scratch(spark, "ingest")
    files.write_vectors(made.select("chunk_id", "page_id", "chunk_index", F.lit(0).cast("long").alias("root_id"), "embedding"), path)
    held = files.read_store(spark, path)
    asked = held.where("page_id % 50 = 0 and chunk_index = 0").select(F.col("chunk_id").alias("query_id"), "root_id", "embedding")
    return vectors.search(asked, held, k=1).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- values of metadata and errors


@query(SQL["complex_tables"])
def table_artifacts(spark, sf_dir):
    """Extracted tables written as JSON, a folder per page, and read back."""
    pages = _table_pages(spark, sf_dir).selectExpr("page_id", "html || html as html")
    path = files.write_artifacts(markup.extract_tables(markup.tokens(pages)), "tables", scratch(spark, "artifacts"))
    row = F.from_json("value", "page_id long, table_id string, row_count int, caption string")
    return files.read_artifacts(spark, path).select(row.alias("r")).select("r.page_id", "r.table_id", "r.row_count", "r.caption")


_META = "select doc_id, lang, case doc_id % 4 when 0 then ' ' || n_chars || ' ' when 1 then 'n/a' when 2 then n_chars || '.5' else ' ' end as value from documents"


@query(f"select doc_id, case when trim(value) = '' then lang else value end as as_string, case when doc_id % 4 = 0 then trim(value)::int end as as_int, try_cast(trim(value) as double) as as_double from ({_META})")
def metadata_values(spark, sf_dir):
    m, value = derived(spark, sf_dir, _META), F.col("value")
    return m.select("doc_id", fn.meta_string(value, F.col("lang")).alias("as_string"), fn.meta_int(value).alias("as_int"), fn.meta_double(value).alias("as_double"))


@query("select doc_id, case when length(text) > 500 then substring(text, 1, 500) || '...' else coalesce(text, '') end as page_error, case when length(text) > 500 then substring(text, 1, 500) || '...' else coalesce(text, '') end as file_error from documents")
def error_texts(spark, sf_dir):
    """Errors are kept to 500 characters; here the documents' texts stand for them."""
    return load(spark, sf_dir, "documents").select("doc_id", manifest.error_text(F.col("text")).alias("page_error"), att.analysis_error(F.col("text")).alias("file_error"))


_TITLES = "select doc_id, case when doc_id % 3 = 0 then ' ' else source end as title, case when doc_id % 2 = 0 then lang end as heading_path, n_chars / 1000.0 as score from documents"


@query(f"select doc_id, case when doc_id % 3 = 0 then 'Untitled' else title end || case when doc_id % 2 = 0 then ' › ' || lang else '' end as title_line from ({_TITLES.replace('select doc_id', 'select doc_id, lang', 1)}) where score >= 0.5")
def titled_hits(spark, sf_dir):
    return retrieval.titled(vectors.min_score(derived(spark, sf_dir, _TITLES), 0.5)).select("doc_id", "title_line")


@query(f"select chunk_id, page_id from ({fx.VECTORS}) where page_id not in (select page_id from ({fx.VECTORS}) where page_id % 3 = 0)")
def delete_pages(spark, sf_dir):
    v = derived(spark, sf_dir, fx.VECTORS)
    return vectors.delete_pages(v, v.where("page_id % 3 = 0")).select("chunk_id", "page_id")


# ---------------------------------------------------------------- files of other programs


_PAGE_FILES = "select page_id, page_id % 7 as root_id, 'Page ' || url || chr(10) as md, url from pages"


@query(f"select page_id, md from ({_PAGE_FILES}) where page_id % 3 <> 0 union all select page_id, 'old ' || url from ({_PAGE_FILES}) where page_id % 3 = 0")
def page_files(spark, sf_dir):
    """Pages written as files and read back; a third has the older file name only, and half have both."""
    path, p = scratch(spark, "pages"), derived(spark, sf_dir, _PAGE_FILES)
    files.write_pages(p.where("page_id % 3 <> 0"), path)
    files.write_files(p.where("page_id % 3 = 0 or page_id % 2 = 0").selectExpr("concat(root_id, '/', page_id, '/page.md') as name", "encode(concat('old ', url), 'UTF-8') as content"), path)
    return files.read_markdown(spark, path)


@query("select page_id, url, case when page_id % 2 = 0 then 1 + page_id % 3 else 0 end as n_tables, case when page_id % 2 = 0 then 'table-1' end as first_table, page_id % 5 = 0 as has_assets from pages")
def page_documents(spark, sf_dir):
    """Pages with the lists of their tables and assets, written as JSON documents beside the Markdown and read back."""
    path, p = scratch(spark, "documents"), load(spark, sf_dir, "pages").selectExpr("page_id", "page_id % 7 as root_id", "url", "url as md")
    tables = p.where("page_id % 2 = 0").selectExpr("page_id", "explode(sequence(1, cast(1 + page_id % 3 as int))) as n").selectExpr("page_id", "n as ord", "concat('table-', n) as table_id")
    assets = p.where("page_id % 5 = 0").selectExpr("page_id", "concat('f', page_id, '.png') as file_name")
    files.write_pages(files.page_documents(p, tables=tables, assets=assets), path)
    held = files.read_json(spark, f"{path}/*/*/metadata.json", "page_id long, url string, tables array<struct<ord: int, table_id: string>>, assets array<struct<file_name: string>>")
    return held.selectExpr("page_id", "url", "cast(coalesce(size(tables), 0) as bigint) as n_tables", "tables[0].table_id as first_table", "assets is not null as has_assets")


@query("select page_id, 'f' || page_id || '.png' as file_name, strlen(coalesce(html, '')) as n_bytes, sha256(coalesce(html, '')) as checksum from pages where html <> ''")
def asset_files(spark, sf_dir):
    """Assets written as files beside table artifacts and JSON, which the reader leaves out."""
    path, p = scratch(spark, "assets"), load(spark, sf_dir, "pages").selectExpr("page_id", "encode(coalesce(html, ''), 'UTF-8') as content")
    names = "array(concat(page_id, '/assets/f', page_id, '.png'), concat(page_id, '/assets/tables/t.png'), concat(page_id, '/assets/m.json'))"
    files.write_files(p.selectExpr(f"explode({names}) as name", "if(name like '%/f%', content, cast('{}' as binary)) as content"), path)
    found = files.read_assets(spark, path)
    return found.select(F.regexp_extract("path", r"/(\d+)/assets/", 1).cast("long").alias("page_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("length").alias("n_bytes"), fn.checksum(F.col("content")).alias("checksum"))


@query(f"with a as ({fx.ATTACHMENTS}) select page_id, 'assets/' || file_name as relative_path, case when ord % 4 = 0 then 'again' else status end as status, case when ord % 3 = 0 then 'PHOTO' when ord % 3 = 1 then 'TABLE_IMAGE' else 'UNKNOWN' end as detected_type from a")
def attachment_manifests(spark, sf_dir):
    """Manifests of attachments, a file per page, some of which name a path twice; types come from the labels of a vision model."""
    path, a = scratch(spark, "manifests"), derived(spark, sf_dir, fx.ATTACHMENTS)
    label = "case ord % 3 when 0 then ' Photo ' when 1 then 'table' else 'cat' end"
    rows = a.selectExpr("page_id", "ord", "file_name", "concat('assets/', file_name) as relative_path", f"{label} as label", "explode(if(ord % 4 = 0, array(status, 'again'), array(status))) as status")
    rows = rows.withColumn("detected_type", fn.vision_type(F.col("label"))).withColumn("turn", (F.col("status") == "again").cast("int"))
    listed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ord", "page_id", "file_name", "relative_path", "detected_type", "status"))).alias("attachments"))
    files.write_files(listed.selectExpr("concat(page_id, '/attachments.json') as name", "encode(to_json(struct(attachments)), 'UTF-8') as content"), path)
    return files.read_attachments(spark, f"{path}/*/attachments.json").select("page_id", "relative_path", "status", "detected_type")
